"""Events stored by day: an append reads only the days that its batch touches, retention drops whole days.

A day is a folder ``day=YYYY-MM-DD`` of the event's time. An event is told by its key within its day; a replay carries its
time, so it meets itself. Days are replaced by dynamic partition overwrite, from rows staged beside the store, so other days
are not touched.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "day"


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored_days(spark: SparkSession, path: str) -> list[date]:
    """The days that the store has, from its folders' names."""
    at, fs = _folder(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(date.fromisoformat(n.removeprefix(f"{DAY}=")) for n in names if n.startswith(f"{DAY}=") and n[len(DAY) + 1 :] != "__HIVE_DEFAULT_PARTITION__")


def read(spark: SparkSession, path: str, like: DataFrame, days: list[date] | None = None) -> DataFrame:
    """The stored events with their ``day``, of some days only if they are given; no rows if nothing is there yet."""
    at, fs = _folder(spark, path)
    schema = like.drop(DAY).withColumn(DAY, F.lit(None).cast("date")).schema
    if not fs.exists(at):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    return rows if days is None else rows.filter(F.col(DAY).isin(days))


def unseen(events: DataFrame, path: str, key: str = "feedback_id", time: str = "event_time") -> DataFrame:
    """The batch's events that the store does not have, each once, the first of equal keys of a day by time; rows without a time are left out.

    The days of the batch, as many as it has, are gathered first and prune the stored side's folders.
    """
    rows = events.filter(F.col(time).isNotNull()).withColumn(DAY, F.to_date(time))
    days = [r[0] for r in rows.select(DAY).distinct().collect()]
    rest = [c for c in events.columns if c not in (key, time)]
    first = rows.groupBy(key, DAY).agg(F.min(F.struct(time, *rest)).alias("x")).select(key, DAY, "x.*")
    known = read(events.sparkSession, path, events, days).select(F.col(key).alias("_key"), F.col(DAY).alias("_day"))
    return first.join(known, F.col(key).eqNullSafe(F.col("_key")) & (F.col(DAY) == F.col("_day")), "left_anti").select(*events.columns, DAY)


def append(events: DataFrame, path: str, key: str = "feedback_id", time: str = "event_time") -> None:
    """Append what is new; a batch that comes again adds nothing."""
    unseen(events, path, key, time).write.partitionBy(DAY).mode("append").parquet(path)


def _replace(rows: DataFrame, path: str) -> None:
    """Put ``rows``, which may be read from the store, in place of their days."""
    spark = rows.sparkSession
    staged = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    spark.read.schema(rows.schema).parquet(staged).write.option("partitionOverwriteMode", "dynamic").partitionBy(DAY).mode("overwrite").parquet(path)
    at, fs = _folder(spark, staged)
    fs.delete(at, True)


def compact(spark: SparkSession, path: str, days: list[date], like: DataFrame, key: str = "feedback_id", time: str = "event_time") -> None:
    """Rewrite some days with each key once, in few files; other days are not read."""
    rows = read(spark, path, like, days)
    rest = [c for c in rows.columns if c not in (key, time, DAY)]
    one = rows.groupBy(key, DAY).agg(F.min(F.struct(time, *rest)).alias("x")).select(key, "x.*", DAY).select(*rows.columns)
    _replace(one.repartition(DAY), path)


def purge(spark: SparkSession, path: str, as_of: datetime, keep_days: int, like: DataFrame, time: str = "event_time") -> None:
    """Drop events older than the retention: whole days go as folders, the day of the cutoff is rewritten."""
    cutoff = as_of - timedelta(days=keep_days)
    for day in stored_days(spark, path):
        if day < cutoff.date():
            at, fs = _folder(spark, f"{path}/{DAY}={day.isoformat()}")
            fs.delete(at, True)
    edge = read(spark, path, like, [cutoff.date()])
    if edge.filter(F.col(time) < F.lit(cutoff)).head(1):
        kept = edge.filter(F.col(time) >= F.lit(cutoff))
        if kept.head(1):
            _replace(kept, path)
        else:
            at, fs = _folder(spark, f"{path}/{DAY}={cutoff.date().isoformat()}")
            fs.delete(at, True)
