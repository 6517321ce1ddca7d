"""One registry of row predicates that validation, profiling and features share."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import TRANSACTION_TYPES

DEBIT_TYPES = ("CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")
CREDIT_TYPES = ("CASH_IN", "PAYMENT", "TRANSFER")
BALANCES = ("origin_balance_before", "origin_balance_after", "destination_balance_before", "destination_balance_after")
#: Of the rules.
RULE_TOLERANCE = 1e-6
#: Of the behaviour profile.
PROFILE_TOLERANCE = 0.01


def any_null(columns: Iterable[str]) -> Column:
    return reduce(Column.__or__, [F.col(c).isNull() for c in columns])


def off_by(actual: Column, expected: Column, tolerance: float) -> Column:
    return F.abs(actual - expected) > tolerance


def negative_balance() -> Column:
    return reduce(Column.__or__, [F.col(c) < 0 for c in BALANCES])


def origin_inconsistent(tolerance: float = RULE_TOLERANCE) -> Column:
    """Debits end at the balance less the amount, not below zero; credits at the sum."""
    kind, before, after, amount = (F.col(c) for c in ("transaction_type", "origin_balance_before", "origin_balance_after", "amount"))
    debit = kind.isin(*DEBIT_TYPES) & off_by(after, F.greatest(before - amount, F.lit(0.0)), tolerance)
    return debit | ((kind == "CASH_IN") & off_by(after, before + amount, tolerance))


def destination_inconsistent(tolerance: float = RULE_TOLERANCE) -> Column:
    kind, before, after, amount = (F.col(c) for c in ("transaction_type", "destination_balance_before", "destination_balance_after", "amount"))
    return kind.isin(*CREDIT_TYPES) & off_by(after, before + amount, tolerance)


def unknown_type(column: str = "transaction_type") -> Column:
    return ~F.col(column).isin(*TRANSACTION_TYPES)


RULES = {"negative_balance": negative_balance, "origin_inconsistent": origin_inconsistent, "destination_inconsistent": destination_inconsistent}
