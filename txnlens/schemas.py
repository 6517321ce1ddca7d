"""The fixed table schemas and one comparator for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType, TimestampType

TRANSACTION_TYPES = ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")

_KINDS = {"int": IntegerType, "double": DoubleType, "string": StringType, "timestamp": TimestampType}


def _struct(columns: str) -> StructType:
    """A schema from ``name type, ...``; unlike Spark's own parser it needs no session."""
    pairs = [c.split() for c in columns.split(",")]
    return StructType([StructField(name, _KINDS[kind]()) for name, kind in pairs])


# Columns and types of the data model.
RAW = _struct("step int, type string, amount double, nameOrig string, oldbalanceOrg double, newbalanceOrig double, nameDest string, oldbalanceDest double, newbalanceDest double, isFraud int, isFlaggedFraud int")
CANONICAL = _struct(
    "transaction_id string, timestamp timestamp, transaction_type string, origin_account_id string, destination_account_id string, amount double, "
    "origin_balance_before double, origin_balance_after double, destination_balance_before double, destination_balance_after double, is_fraud int, is_flagged_fraud int"
)
FEATURES = _struct(
    "transaction_id string, timestamp timestamp, transaction_type string, origin_account_id string, destination_account_id string, amount double, amount_log double, "
    "origin_balance_before double, origin_balance_after double, origin_balance_delta double, origin_balance_change_ratio double, amount_to_origin_balance_ratio double, "
    "destination_balance_before double, destination_balance_after double, destination_balance_delta double, destination_balance_change_ratio double, amount_to_destination_balance_ratio double, "
    "origin_balance_mismatch int, destination_balance_mismatch int, is_zero_origin_balance_before int, is_zero_destination_balance_before int, origin_balance_depleted int, destination_balance_increased int, "
    "transaction_hour int, transaction_day_of_week int, is_cash_in int, is_cash_out int, is_debit int, is_payment int, is_transfer int, "
    "transactions_last_1h int, transactions_last_24h int, amount_sum_last_24h double, unique_destinations_last_30d int, is_fraud int, is_flagged_fraud int"
)
PREDICTION_EVENTS = _struct(
    "feedback_id string, schema_version string, event_time timestamp, model_name string, model_version string, feature_contract_version string, "
    "features_json string, risk_score double, decision_threshold double, decision string, latency_seconds double, stored_at timestamp"
)
DELAYED_LABELS = _struct("feedback_id string, schema_version string, label int, label_time timestamp, stored_at timestamp")


def schema_errors(actual: StructType, expected: StructType) -> list[str]:
    """Differences in count, order, names and types; nullability is ignored."""
    errors = []
    if len(actual) != len(expected):
        errors.append(f"{len(actual)} columns, expected {len(expected)}")
    for i, (a, e) in enumerate(zip(actual, expected, strict=False)):
        if a.name != e.name:
            errors.append(f"column {i} is {a.name}, expected {e.name}")
        elif a.dataType != e.dataType:
            errors.append(f"{a.name} is {a.dataType.simpleString()}, expected {e.dataType.simpleString()}")
    return errors


def require_schema(df: DataFrame, expected: StructType) -> DataFrame:
    if errors := schema_errors(df.schema, expected):
        raise ValueError("schema mismatch: " + "; ".join(errors))
    return df
