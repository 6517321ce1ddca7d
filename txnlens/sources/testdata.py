"""The test tables seen as payments, prediction events, labels and scores. Every column is derived row by row."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import read_parquet

AS_OF = datetime(2024, 2, 1)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", columns or None)


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw payments between a customer and the order's first supplier; a fixed part of the balances is off."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    suppliers = table(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal")
    first = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s_suppkey"))
    rows = orders.join(first, orders["o_orderkey"] == first["l_orderkey"]).join(suppliers, "s_suppkey").join(customers, orders["o_custkey"] == customers["c_custkey"])
    kind = F.element_at(F.array(*map(F.lit, ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    amount, before, to_before = F.col("o_totalprice"), F.col("c_acctbal"), F.col("s_acctbal")
    after = F.when(kind == "CASH_IN", before + amount).otherwise(F.greatest(before - amount, F.lit(0.0))) + F.when(F.col("o_orderkey") % 7 == 0, 1.5).otherwise(0.0)
    to_after = to_before + amount + F.when(F.col("o_orderkey") % 5 == 0, 1.5).otherwise(0.0)
    step = F.floor((F.unix_timestamp("o_orderdate") - 694224000) / 3600)  # hours since 1992
    return rows.select(
        step.cast("int").alias("step"), kind.alias("type"), amount.alias("amount"), F.concat(F.lit("C"), "o_custkey").alias("nameOrig"), before.alias("oldbalanceOrg"), after.alias("newbalanceOrig"),
        F.concat(F.lit("S"), "s_suppkey").alias("nameDest"), to_before.alias("oldbalanceDest"), to_after.alias("newbalanceDest"),
        (F.col("o_orderstatus") == "F").cast("int").alias("isFraud"), (F.col("o_orderkey") % 97 == 0).cast("int").alias("isFlaggedFraud"),
    )


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transactions of a user towards an event type."""
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value").select(
        F.col("event_id").alias("transaction_id"), F.col("ts").alias("timestamp"), F.col("user_id").alias("origin_account_id"), F.col("event_type").alias("destination_account_id"), F.col("value").alias("amount")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, label, score): two models' scores of the events."""
    return scores_of(table(spark, sf_dir, "events", "event_id", "value"))


def scores_of(e: DataFrame) -> DataFrame:
    """The two models' scores of some events."""
    label = (F.col("event_id") % 7 == 0).cast("int")
    alpha = e.select(F.lit("alpha").alias("model"), label.alias("label"), F.least(F.col("value") / 400.0, F.lit(1.0)).alias("score"))
    return alpha.unionByName(e.select(F.lit("beta").alias("model"), label.alias("label"), ((F.col("event_id") * 37 % 1000) / 1000.0).alias("score")))


def prediction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    score = F.least(F.col("value") / 400.0, F.lit(1.0))
    return e.select(
        F.col("event_id").cast("string").alias("feedback_id"), F.col("ts").alias("event_time"), F.when(F.col("user_id") % 3 == 0, "risk").otherwise("risk model").alias("model_name"),
        F.concat(F.lit("v"), F.col("user_id") % 2).alias("model_version"), F.lit("pre-transaction-v1").alias("feature_contract_version"), score.alias("risk_score"), F.lit(0.25).alias("decision_threshold"),
    )


def segment_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Prediction events with the features ``amount`` and ``hour``, before a day (reference) and from it on; one segment has amounts that are not finite."""
    e = table(spark, sf_dir, "events", "event_id", "value").select(F.col("event_id").cast("string").alias("feedback_id"), "value", (F.col("event_id") % 24).cast("double").alias("hour"))
    rows = prediction_events(spark, sf_dir).join(e, "feedback_id")
    odd = (F.col("model_name") == "risk model") & (F.col("model_version") == "v0") & (F.col("feedback_id").cast("long") % 100 == 0)
    rows = rows.withColumn("amount", F.when(odd, F.lit(float("inf"))).otherwise(F.col("value"))).drop("value")
    return rows.filter("event_time < '2024-01-16'"), rows.filter("event_time >= '2024-01-16'")


def contract_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as full prediction records with two features; fixed parts break one rule each."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "value")
    each = lambda k: F.col("event_id") % k == 0
    number = F.when(each(23), '"much"').otherwise(F.col("event_id").cast("string"))
    amount = F.when(each(31), "").otherwise(F.concat(F.lit('"amount":'), number, F.lit(",")))
    features = F.concat(F.lit("{"), amount, F.lit('"transaction_type":"'), F.when(each(29), "X").otherwise("PAYMENT"), F.lit('"}'))
    uuid = F.format_string("%08x-0000-4000-8000-%012x", "event_id", "event_id")
    return e.select(
        F.col("event_id"), F.when(each(11), F.concat(F.lit("x"), "event_id")).otherwise(uuid).alias("feedback_id"), F.when(each(13), "prediction-event-v0").otherwise("prediction-event-v1").alias("schema_version"),
        F.when(~each(17), F.col("ts")).alias("event_time"), F.when(each(19), "").otherwise("risk").alias("model_name"), F.lit("v1").alias("model_version"), F.lit("pre-transaction-v1").alias("feature_contract_version"),
        features.alias("features_json"), (F.col("value") / 400.0).alias("risk_score"), F.lit(0.25).alias("decision_threshold"), F.when(each(37), "maybe").otherwise("review").alias("decision"),
        (F.col("event_id") % 41 - 1).cast("double").alias("latency_seconds"),
    )


def contract_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delayed labels with a version; fixed parts have another version or a label beyond 1."""
    labels = delayed_labels(spark, sf_dir)
    return labels.withColumns({"schema_version": F.when(F.col("feedback_id").endswith("3"), "delayed-label-v0").otherwise("delayed-label-v1"), "label": F.when(F.col("feedback_id").endswith("7"), 2).otherwise(F.col("label"))})


def delayed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the events get a label, some before the event; some labels are of no event."""
    e = table(spark, sf_dir, "events", "event_id", "ts")
    at = F.col("ts") + F.make_interval(days=(F.col("event_id") % 10 - 1).cast("int"))
    own = e.filter("event_id % 3 = 0").select(F.col("event_id").cast("string").alias("feedback_id"), (F.col("event_id") % 2).cast("int").alias("label"), at.alias("label_time"))
    lost = e.filter("event_id % 50 = 0").select(F.concat(F.lit("x"), "event_id").alias("feedback_id"), F.lit(1).alias("label"), F.col("ts").alias("label_time"))
    return own.unionByName(lost)


def label_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feedback_id, label, arrival): several submissions of each user's outcome."""
    return table(spark, sf_dir, "events", "event_id", "user_id", "event_type").select(F.col("user_id").cast("string").alias("feedback_id"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"), F.col("event_id").alias("arrival"))
