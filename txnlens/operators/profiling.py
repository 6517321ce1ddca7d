"""Balance profiles: flags of a row, and their counts and rates by transaction type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def consistency_by_type(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    origin, destination = F.count_if(F.coalesce(rules.origin_inconsistent(), F.lit(False))), F.count_if(F.coalesce(rules.destination_inconsistent(), F.lit(False)))
    return (
        df.groupBy("transaction_type")
        .agg(
            n.alias("transaction_count"), origin.alias("inconsistent_origin_count"), destination.alias("inconsistent_destination_count"),
            (origin / n).alias("origin_inconsistency_rate"), (destination / n).alias("destination_inconsistency_rate"),
        )
        .orderBy("transaction_type")
    )


def behavior_flags(df: DataFrame, tolerance: float = rules.PROFILE_TOLERANCE) -> DataFrame:
    """Deltas, the expected delta (null for an unknown type), and three matches."""
    kind, amount = F.col("transaction_type"), F.col("amount")
    origin = F.col("origin_balance_after") - F.col("origin_balance_before")
    destination = F.col("destination_balance_after") - F.col("destination_balance_before")
    debit = kind.isin(*rules.DEBIT_TYPES)
    expected = F.when(kind == "CASH_IN", amount).when(debit, -amount)
    return df.withColumns(
        {
            "origin_delta": origin, "destination_delta": destination, "origin_expected_delta": expected,
            "origin_exact_match": F.abs(origin - expected) <= tolerance,
            "origin_floor_match": debit & (F.col("origin_balance_before") < amount) & (F.abs("origin_balance_after") <= tolerance),
            "destination_plus_amount_match": F.abs(destination - amount) <= tolerance,
        }
    )


def behavior_by_type(flags: DataFrame) -> DataFrame:
    """Matches and mismatches by type. A null flag counts as no match; a row that matches exactly and by floor is taken off twice."""
    n = F.count(F.lit(1))
    exact, floor, plus = (F.count_if(F.coalesce(F.col(c), F.lit(False))) for c in ("origin_exact_match", "origin_floor_match", "destination_plus_amount_match"))
    return (
        flags.groupBy("transaction_type")
        .agg(
            n.alias("transaction_count"), exact.alias("origin_exact_match_count"), floor.alias("origin_floor_match_count"), plus.alias("destination_plus_amount_match_count"),
            (n - exact - floor).alias("origin_mismatch_count"), ((n - exact - floor) / n).alias("origin_mismatch_rate"),
            (n - plus).alias("destination_mismatch_count"), ((n - plus) / n).alias("destination_mismatch_rate"),
        )
        .orderBy("transaction_type")
    )
