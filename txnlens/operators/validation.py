"""Validation: each table is judged by one aggregate, whose row is the result."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType

from ..functions import rules
from ..schemas import CANONICAL, RAW, require_schema

# Columns that a canonical row must have.
_REQUIRED = ("transaction_id", "timestamp", "transaction_type", "origin_account_id", "destination_account_id", "amount", "is_fraud", "is_flagged_fraud")


def _count(condition: Column) -> Column:
    """Rows for which the condition holds; 0 for an empty table."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def validate_raw(raw: DataFrame) -> DataFrame:
    """Row count, rows with nulls, negative amounts and steps, unknown types, and either label other than 0 and 1."""
    if missing := sorted(set(RAW.names) - set(raw.columns)):
        raise ValueError(f"raw columns are missing: {missing}")
    return raw.agg(
        F.count(F.lit(1)).alias("row_count"),
        _count(rules.any_null(RAW.names)).alias("null_count"),
        _count(F.col("amount") < 0).alias("invalid_amount_count"),
        _count(F.col("step") < 0).alias("invalid_step_count"),
        _count(rules.unknown_type("type")).alias("invalid_type_count"),
        _count(~F.col("isFraud").isin(0, 1)).alias("invalid_fraud_label_count"),
        _count(~F.col("isFlaggedFraud").isin(0, 1)).alias("invalid_flagged_fraud_count"),
    )


def duplicate_keys(df: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def validate_canonical(df: DataFrame) -> DataFrame:
    """One row: counts of nulls in required columns, malformed ids, amounts, types, labels, duplicate keys; and ``is_valid``.

    The duplicate count needs its own shuffle on the key; both aggregates are single rows that meet without a join key.
    """
    require_schema(df, CANONICAL)
    # rows of one key first: the key is hashed once and all counts follow from the groups
    flags = {
        "null_count": rules.any_null(_REQUIRED), "invalid_transaction_id_count": F.length("transaction_id") != 64, "invalid_amount_count": F.col("amount") < 0,
        "invalid_transaction_type_count": rules.unknown_type(), "invalid_fraud_label_count": ~F.col("is_fraud").isin(0, 1),
        "invalid_flagged_fraud_count": ~F.col("is_flagged_fraud").isin(0, 1), "null_balance_count": rules.any_null(rules.BALANCES),
    }
    keyed = df.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"), *[_count(c).alias(k) for k, c in flags.items()])
    total = keyed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in flags], _count(F.col("n") > 1).alias("duplicate_transaction_id_count"))
    bad = sum((F.col(k) for k in [*flags, "duplicate_transaction_id_count"] if k != "null_balance_count"), F.lit(0))
    return total.withColumn("is_valid", (F.col("row_count") > 0) & (bad == 0))


def validate_domain(df: DataFrame) -> DataFrame:
    """One row with the number of rows that break each balance rule."""
    return df.agg(
        _count(rules.negative_balance()).alias("negative_balance_count"),
        _count(rules.origin_inconsistent()).alias("origin_balance_mismatch_count"),
        _count(rules.destination_inconsistent()).alias("destination_balance_mismatch_count"),
    )


def violations(df: DataFrame, rule: str) -> DataFrame:
    """The rows that break a rule of the registry."""
    return df.filter(F.coalesce(rules.RULES[rule](), F.lit(False)))


def invalid_numbers(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows with a null, a NaN or an infinity in a numeric column."""
    kinds = {f.name: f.dataType for f in df.schema}
    names = list(columns) if columns is not None else [c for c, t in kinds.items() if isinstance(t, (DoubleType, FloatType, IntegerType, LongType))]
    bad = F.lit(False)
    for c in names:
        bad = bad | F.col(c).isNull()
        if isinstance(kinds[c], (DoubleType, FloatType)):
            bad = bad | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.filter(bad)


def require_numbers(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    if not invalid_numbers(df, columns).isEmpty():
        raise ValueError("numeric features hold nulls or values that are not finite")
    return df


def require_valid(result: DataFrame, allowed: Iterable[str] = ()) -> dict:
    """The row of a validation as a dict; an error that names the counts over zero, but those allowed."""
    row = result.first().asDict()
    wrong = {k: v for k, v in row.items() if k.endswith("_count") and k != "row_count" and k not in set(allowed) and v}
    if wrong or not row.get("row_count", 1):
        raise ValueError(f"validation failed: {wrong or 'no rows'}")
    return row
