"""Sinks: Parquet, first-write-wins labels, JSON replaced atomically, metrics text; events are in ``event_store``."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.monitoring import settle_labels


def write_parquet(df: DataFrame, path: str, files: int = 8, mode: str = "overwrite") -> None:
    """Write ``files`` files, fewer only if there are fewer rows: rows are dealt out anew, which unlike coalesce leaves the stages above at full width."""
    if files < 1:
        raise ValueError("at least one output file is needed")
    df.repartition(files).write.mode(mode).parquet(path)


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at a path, or no rows of ``like``'s schema if nothing is there yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(like.schema).parquet(path) if there else like.limit(0)


def submit_labels(labels: DataFrame, path: str, order: str = "stored_at") -> DataFrame:
    """Write the labels that are first for their id; each submission with its outcome: accepted, duplicate or conflict.

    The outcome is computed before the write from what is stored then, and gathered as rows of this batch only.
    """
    spark = labels.sparkSession
    stored = read_or_empty(spark, path, labels)
    both = stored.withColumn("_batch", F.lit(0)).unionByName(labels.withColumn("_batch", F.lit(1)))
    ranked = both.withColumn("_arrival", F.struct("_batch", order, F.monotonically_increasing_id()))
    settled = settle_labels(ranked, "_arrival").filter("_batch = 1").drop("_batch", "_arrival").persist()
    settled.count()
    settled.filter("outcome = 'accepted'").select(*labels.columns).write.mode("append").parquet(path)
    return settled


def write_json(value: object, path: str | Path) -> None:
    """Write a small JSON file whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(fd, "w") as f:
        json.dump(value, f, indent=2, sort_keys=True, default=str)
    os.replace(name, path)


def exposition(samples: DataFrame, name: str, value: str, labels: list[str]) -> DataFrame:
    """One ``line`` a sample in the text format that metric servers scrape."""
    pair = lambda c: F.concat(F.lit(f'{c}="'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r'(["\\])', r"\\$1"), F.lit('"'))
    body = F.concat_ws(",", *[pair(c) for c in labels])
    return samples.select(F.concat(F.lit(name), F.when(body != "", F.concat(F.lit("{"), body, F.lit("}"))).otherwise(F.lit("")), F.lit(" "), F.col(value).cast("string")).alias("line"))
