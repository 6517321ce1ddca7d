"""The ordered model feature contract, and the columns that must never reach a model."""

from __future__ import annotations

from collections.abc import Iterable

CONTRACT_VERSION = "pre-transaction-v1"

# The contract's features in order.
MODEL_FEATURES = (
    "transaction_type", "amount", "amount_log", "origin_balance_before", "amount_to_origin_balance_ratio", "destination_balance_before",
    "amount_to_destination_balance_ratio", "is_zero_origin_balance_before", "is_zero_destination_balance_before", "transaction_hour",
    "transaction_day_of_week", "is_cash_in", "is_cash_out", "is_debit", "is_payment", "is_transfer",
)
CATEGORICAL_FEATURES = ("transaction_type",)
# Columns that must never reach a model, by the reason.
IDENTIFIERS = ("transaction_id", "origin_account_id", "destination_account_id", "timestamp", "is_fraud", "is_flagged_fraud")
POST_EVENT = (
    "origin_balance_after", "destination_balance_after", "origin_balance_delta", "destination_balance_delta", "origin_balance_change_ratio",
    "destination_balance_change_ratio", "origin_balance_mismatch", "destination_balance_mismatch", "origin_balance_depleted", "destination_balance_increased",
)
HISTORICAL = ("transactions_last_1h", "transactions_last_24h", "amount_sum_last_24h", "unique_destinations_last_30d")
FORBIDDEN = frozenset((*IDENTIFIERS, *POST_EVENT, *HISTORICAL))
TARGET = "is_fraud"
MODEL_DATASET = ("transaction_id", *MODEL_FEATURES, TARGET)


def passes(columns: Iterable[str]) -> bool:
    """Whether the columns are the contract's, exactly and in order."""
    try:
        check_features(columns)
    except ValueError:
        return False
    return True


def check_features(columns: Iterable[str]) -> tuple[str, ...]:
    """The columns, if they are the contract's exactly and in order; else an error that names what is wrong."""
    names = tuple(columns)
    twice = sorted({c for c in names if names.count(c) > 1})
    forbidden = sorted(FORBIDDEN.intersection(names))
    missing = [c for c in MODEL_FEATURES if c not in names]
    extra = sorted(set(names) - set(MODEL_FEATURES) - FORBIDDEN)
    for what, found in (("duplicate", twice), ("forbidden", forbidden), ("missing", missing), ("unexpected", extra)):
        if found:
            raise ValueError(f"{what} model features: {found}")
    if names != MODEL_FEATURES:
        raise ValueError("model features are out of order")
    return names
