"""Row-local feature expressions, by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import TRANSACTION_TYPES
from .rules import destination_inconsistent, origin_inconsistent


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """0.0 unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(0.0)


def amount_features() -> dict[str, Column]:
    amount = F.col("amount")
    return {
        "amount_log": F.log1p(amount),
        "amount_to_origin_balance_ratio": guarded_ratio(amount, F.col("origin_balance_before")),
        "amount_to_destination_balance_ratio": guarded_ratio(amount, F.col("destination_balance_before")),
    }


def balance_features() -> dict[str, Column]:
    out: dict[str, Column] = {}
    for side in ("origin", "destination"):
        before, after = F.col(f"{side}_balance_before"), F.col(f"{side}_balance_after")
        out[f"{side}_balance_delta"] = after - before
        out[f"{side}_balance_change_ratio"] = guarded_ratio(after - before, before)
        out[f"is_zero_{side}_balance_before"] = (before == 0).cast("int")
    out["origin_balance_mismatch"] = origin_inconsistent().cast("int")
    out["destination_balance_mismatch"] = destination_inconsistent().cast("int")
    out["origin_balance_depleted"] = (F.col("origin_balance_after") == 0).cast("int")
    out["destination_balance_increased"] = (F.col("destination_balance_after") > F.col("destination_balance_before")).cast("int")
    return out


def calendar_features() -> dict[str, Column]:
    """Hour, and day of the week with Sunday as 1."""
    return {"transaction_hour": F.hour("timestamp"), "transaction_day_of_week": F.dayofweek("timestamp")}


def type_indicators() -> dict[str, Column]:
    return {f"is_{t.lower()}": (F.col("transaction_type") == t).cast("int") for t in TRANSACTION_TYPES}


def row_features() -> dict[str, Column]:
    return amount_features() | balance_features() | calendar_features() | type_indicators()
