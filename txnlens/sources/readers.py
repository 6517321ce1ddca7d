"""Scans with fixed schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType

from ..schemas import RAW


def utc_timestamps(df: DataFrame) -> DataFrame:
    """Timestamps without a zone as timestamps in the session's zone (UTC)."""
    ntz = [f.name for f in df.schema if isinstance(f.dataType, TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet scan, of the named columns only if given."""
    df = spark.read.parquet(path)
    return utc_timestamps(df.select(*columns) if columns else df)


def read_raw_csv(spark: SparkSession, path: str, keep_malformed: bool = False, schema: StructType = RAW) -> DataFrame:
    """CSV with a header under a fixed schema. A header with other names or order is an error, not bound by position.

    Cells that don't parse become null, and with ``keep_malformed`` the line is kept in ``_corrupt_record``.
    """
    if keep_malformed:
        schema = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)


def read_events_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def parse_features(events: DataFrame, fields: Sequence[str], text: Sequence[str] = ("transaction_type",), column: str = "features_json") -> DataFrame:
    """``features``: the JSON object as a struct, text fields as strings and all others as doubles."""
    ddl = ", ".join(f"`{f}` {'string' if f in text else 'double'}" for f in fields)
    return events.withColumn("features", F.from_json(column, ddl))


def encode_features(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``features_json``: a compact object with sorted names."""
    return df.withColumn("features_json", F.to_json(F.struct(*sorted(fields))))
