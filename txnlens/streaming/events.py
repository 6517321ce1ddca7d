"""Structured Streaming: idempotent events, the delayed join, windowed rates, scoring; operators with keyed state are in ``state``."""

from __future__ import annotations

from datetime import timedelta

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import ml, monitoring
from ..sources import event_store


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedupe_events(events: DataFrame, lateness: str = "10 minutes", key: str = "feedback_id") -> DataFrame:
    """Each event once, if its repeats come within the lateness."""
    return events.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark([key])


def join_labels(events: DataFrame, labels: DataFrame, grace: str = "7 days", lateness: str = "1 hour") -> DataFrame:
    """Events with labels of the grace period; events whose grace has passed without one come out with nulls."""
    e = events.withWatermark("event_time", lateness).alias("e")
    y = labels.select(F.col("feedback_id").alias("label_id"), "label", "label_time").withWatermark("label_time", lateness).alias("y")
    within = (F.col("e.feedback_id") == F.col("y.label_id")) & (F.col("y.label_time") >= F.col("e.event_time")) & (F.col("y.label_time") <= F.col("e.event_time") + F.expr(f"interval {grace}"))
    return e.join(y, within, "leftOuter").drop("label_id")


def windowed_rate(events: DataFrame, is_error: Column, window: str = "5 minutes", lateness: str = "10 minutes", ts: str = "event_time") -> DataFrame:
    """Requests and errors of each window once it is closed."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, window)).agg(F.count(F.lit(1)).alias("requests"), F.count_if(is_error).alias("errors")).select(F.col("window.start").alias("window_start"), "requests", "errors")


def score_stream(transactions: DataFrame, model: PipelineModel, threshold: float) -> DataFrame:
    return monitoring.decide(ml.score(model, transactions), threshold)


def write_events(events: DataFrame, path: str, checkpoint: str):
    """A started query that appends new events to the store by day; a batch that is run again adds nothing."""
    return events.writeStream.foreachBatch(lambda df, _: event_store.append(df, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_console(rows: DataFrame, checkpoint: str, n: int = 20):
    """A started query that prints the first ``n`` rows of each batch, whole values, for watching a stream."""
    return rows.writeStream.format("console").option("numRows", n).option("truncate", "false").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retention_filter(df: DataFrame, time: str, days: int) -> DataFrame:
    return df.filter(F.col(time) >= F.current_timestamp() - F.lit(timedelta(days=days)))
