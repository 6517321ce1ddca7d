"""Raw to canonical rows, and canonical rows to the audit features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import row_features
from ..plans.contract import MODEL_DATASET
from ..schemas import CANONICAL, FEATURES
from .windows import add_behavior_features

BASE_TIME = "2026-01-01 00:00:00"


def canonicalize(raw: DataFrame, base_time: str = BASE_TIME) -> DataFrame:
    """One projection: surrogate key, event time ``step`` hours after the base, and new names."""
    key = F.sha2(F.concat_ws("||", *[F.col(c).cast("string") for c in ("step", "type", "amount", "nameOrig", "nameDest")]), 256)
    source = {
        "transaction_id": key, "timestamp": F.to_timestamp(F.lit(base_time)) + F.make_interval(hours=F.col("step")), "transaction_type": F.col("type"), "origin_account_id": F.col("nameOrig"),
        "destination_account_id": F.col("nameDest"), "amount": F.col("amount"), "origin_balance_before": F.col("oldbalanceOrg"), "origin_balance_after": F.col("newbalanceOrig"),
        "destination_balance_before": F.col("oldbalanceDest"), "destination_balance_after": F.col("newbalanceDest"), "is_fraud": F.col("isFraud"), "is_flagged_fraud": F.col("isFlaggedFraud"),
    }
    return raw.select(*[source[f.name].cast(f.dataType).alias(f.name) for f in CANONICAL])


def build_features(canonical: DataFrame) -> DataFrame:
    """The 36 audit columns in order."""
    return add_behavior_features(canonical.withColumns(row_features())).select(*FEATURES.names)


def model_dataset(features: DataFrame) -> DataFrame:
    """Id, the contract's features and the target; an error if a column is missing."""
    if missing := sorted(set(MODEL_DATASET) - set(features.columns)):
        raise ValueError(f"the model dataset misses {missing}")
    return features.select(*MODEL_DATASET)
