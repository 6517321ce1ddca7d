"""Loading the three persisted splits: schemas, keys, overlaps, summaries and their recorded time ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.contract import MODEL_DATASET, TARGET, check_features
from ..schemas import schema_errors
from .split import SPLITS, overlaps
from .validation import duplicate_keys


@dataclass(frozen=True)
class Dataset:
    splits: dict[str, DataFrame]
    summaries: dict[str, dict]
    duplicates: dict[str, int]
    overlaps: dict[str, int]


def split_summary(df: DataFrame, target: str = TARGET, time: str | None = None) -> DataFrame:
    """Rows, positives, negatives, and the time range if there is a time column; one row."""
    times = [F.min(time).alias("min_timestamp"), F.max(time).alias("max_timestamp")] if time and time in df.columns else []
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col(target) == 1).alias("positive_count"), F.count_if(F.col(target) == 0).alias("negative_count"), *times)


def load_splits(spark: SparkSession, folder: str, columns: tuple[str, ...] = MODEL_DATASET, target: str = TARGET, lineage: dict | None = None) -> Dataset:
    """Read and check ``folder``/train, validation and test; columns are read as asked, others never leave the files."""
    splits = {n: spark.read.parquet(f"{folder}/{n}") for n in SPLITS}
    for name, df in splits.items():
        if missing := [c for c in columns if c not in df.columns]:
            raise ValueError(f"{name} misses {missing}")
        splits[name] = df.select(*columns)
        if errors := schema_errors(splits[name].schema, splits["train"].schema):
            raise ValueError(f"{name} differs from train: {errors}")
    if columns == MODEL_DATASET:
        check_features(columns[1:-1])
    duplicates = {n: duplicate_keys(df).count() for n, df in splits.items()}
    shared = {r["pair"]: r["overlap_count"] for r in overlaps(splits).collect()}
    if any(duplicates.values()) or any(shared.values()):
        raise ValueError(f"duplicate keys {duplicates}, overlaps {shared}")
    summaries = {n: split_summary(df, target).first().asDict() | (lineage or {}).get("splits", {}).get(n, {}) for n, df in splits.items()}
    return Dataset(splits, summaries, duplicates, shared)
