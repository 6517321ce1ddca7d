"""Predictions against labels that arrive later: joins, counters, segments and their performance, as of a given time."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import drift, evaluation

SEGMENT = ("model_name", "model_version", "feature_contract_version")


def _valid(events: DataFrame, labels: DataFrame) -> Column:
    return (events["feedback_id"] == labels["feedback_id"]) & (labels["label_time"] >= events["event_time"])


def retain(df: DataFrame, time: str, as_of: datetime, days: int) -> DataFrame:
    """Rows no older than the retention."""
    return df.filter(F.col(time) >= F.lit(as_of - timedelta(days=days)))


def labelled_events(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Every event with its label and label time, null where no label came at or after it."""
    return events.join(labels, _valid(events, labels), "left").select(events["*"], labels["label"], labels["label_time"])


def latest(df: DataFrame, n: int, time: str = "event_time", key: str = "feedback_id") -> DataFrame:
    """The newest n rows, in ascending order; equal times go by key."""
    return df.orderBy(F.col(time).desc(), F.col(key).desc()).limit(n).orderBy(time, key)


def unmatched_labels(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels that have no event, or came before it."""
    return labels.join(events, _valid(events, labels), "left_anti")


def overdue_events(events: DataFrame, labels: DataFrame, as_of: datetime, grace_days: int) -> DataFrame:
    """Events older than the grace period that have no valid label, however old."""
    return events.filter(F.col("event_time") < F.lit(as_of - timedelta(days=grace_days))).join(labels, _valid(events, labels), "left_anti")


def snapshot(events: DataFrame, labels: DataFrame, as_of: datetime, window_days: int = 30, retention_days: int = 90, grace_days: int = 7, max_events: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The window's newest labelled events, and one row of counters."""
    events, labels = retain(events, "event_time", as_of, retention_days), retain(labels, "label_time", as_of, retention_days)
    window = retain(events, "event_time", as_of, window_days)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counter"), "n")
    counters = count(window, "event_count").unionByName(count(labelled_events(window, labels).filter("label_time is not null"), "joined_label_count"))
    counters = counters.unionByName(count(unmatched_labels(events, labels), "unmatched_label_count")).unionByName(count(overdue_events(events, labels, as_of, grace_days), "late_unlabeled_count"))
    row = counters.groupBy().pivot("counter", ["event_count", "joined_label_count", "unmatched_label_count", "late_unlabeled_count"]).agg(F.first("n"))
    return latest(labelled_events(window, labels), max_events), row.withColumn("truncated", F.col("event_count") > max_events)


def slug(value: Column) -> Column:
    """Characters safe for a file name, 80 at most, ``unknown`` if none are left."""
    cut = F.substring(F.regexp_replace(F.regexp_replace(value, "[^a-zA-Z0-9._-]+", "-"), "^[-._]+|[-._]+$", ""), 1, 80)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("unknown"))


def segments(labelled: DataFrame, reference: dict[str, str] | None, has_reference_rows: bool = True) -> DataFrame:
    """Rows and labels of each segment, a file slug, and what can be said about its drift.

    ``reference``: the segment that the reference rows stand for; others are mismatches.
    """
    same = F.lit(reference is not None)
    for c in SEGMENT:
        same = same & (F.col(c) == F.lit((reference or {}).get(c)))
    n = F.col("event_count")
    status = F.when(~F.coalesce(same, F.lit(False)), "skipped_reference_model_mismatch").when(n < 2, "insufficient_current_rows").when(F.lit(not has_reference_rows), "reference_unavailable").otherwise("generated")
    sums = labelled.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("event_count"), F.count("label").alias("labeled_count"))
    return sums.withColumn("slug", F.concat_ws("-", *[slug(F.col(c)) for c in SEGMENT])).withColumn("drift_status", status)


def segment_drift(labelled: DataFrame, reference: DataFrame, of: dict[str, str] | None, columns: Sequence[str], edges: dict[str, Sequence[float]]) -> DataFrame:
    """One row a segment and feature: the segment's ``drift_status``, and ``psi`` against the reference rows where it is ``generated``.

    A segment that stands to be reported but whose features can't be is ``failed``, with the stage and the kind of error of
    its first fault; the other segments are reported all the same. ``prepare_data``: a feature without any value
    (``MissingFeature``) or with one that is not finite (``InvalidNumber``). ``run_report``: the reference lacks the feature.
    """
    number = lambda c: F.col(f"`{c}`").cast("double")
    odd = lambda c: F.coalesce(F.isnan(number(c)) | (F.abs(number(c)) == float("inf")), F.lit(False))
    checks = F.array(*[F.struct(F.lit(c).alias("feature"), F.count(number(c)).alias("values"), F.count_if(odd(c)).alias("odd")) for c in columns])
    known = reference.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.count(number(c)).alias("n")) for c in columns]).alias("x")).select(F.inline("x")).filter("n > 0")
    status = segments(labelled, of, not reference.isEmpty()).select(*SEGMENT, "drift_status")
    each = labelled.groupBy(*SEGMENT).agg(checks.alias("x")).select(*SEGMENT, F.inline("x"))
    each = each.join(known.withColumn("known", F.lit(True)).drop("n"), "feature", "left")
    fault = F.when(F.col("values") == 0, F.struct(F.lit(0).alias("order"), F.lit("prepare_data").alias("stage"), F.lit("MissingFeature").alias("error")))
    fault = fault.when(F.col("odd") > 0, F.struct(F.lit(1).alias("order"), F.lit("prepare_data").alias("stage"), F.lit("InvalidNumber").alias("error")))
    fault = fault.when(F.col("known").isNull(), F.struct(F.lit(2).alias("order"), F.lit("run_report").alias("stage"), F.lit("MissingReference").alias("error")))
    first = each.groupBy(*SEGMENT).agg(F.min(fault).alias("fault"))
    same = lambda a, b: functools.reduce(operator.and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in SEGMENT])
    failed = (F.col("s.drift_status") == "generated") & F.col("f.fault").isNotNull()
    told = status.alias("s").join(first.alias("f"), same("s", "f")).select(*[F.col(f"s.{c}") for c in SEGMENT], F.when(failed, "failed").otherwise(F.col("s.drift_status")).alias("drift_status"), F.when(failed, F.col("f.fault.stage")).alias("drift_error_stage"), F.when(failed, F.col("f.fault.error")).alias("drift_error"))
    found = drift.psi_by(reference, labelled, SEGMENT, columns, edges)
    rows = each.select(*SEGMENT, "feature").alias("e").join(told.alias("t"), same("e", "t")).join(found.alias("p"), same("e", "p") & (F.col("e.feature") == F.col("p.feature")), "left")
    return rows.select(*[F.col(f"t.{c}") for c in SEGMENT], "e.feature", "t.drift_status", "t.drift_error_stage", "t.drift_error", F.when(F.col("t.drift_status") == "generated", F.col("p.psi")).alias("psi"))


def segment_performance(labelled: DataFrame) -> DataFrame:
    """Metrics of each segment's labelled rows, each row judged at its own threshold; null until both classes have labels."""
    rows = labelled.filter("label is not null").select(*SEGMENT, "label", F.col("risk_score").alias("score"), "decision_threshold")
    at = evaluation.confusion(rows, F.col("decision_threshold"), by=SEGMENT)
    ranked = evaluation.ranking_metrics(rows, by=SEGMENT)
    joined = labelled.select(*SEGMENT).distinct().join(at, list(SEGMENT), "left").join(ranked, list(SEGMENT), "left")
    both = (F.col("true_positives") + F.col("false_negatives") > 0) & (F.col("true_negatives") + F.col("false_positives") > 0)
    status = F.when(F.col("row_count").isNull(), "awaiting_labels").when(~both, "awaiting_both_label_classes").otherwise("computed")
    metrics = ["precision", "recall", "f1", "roc_auc", "pr_auc", "brier_score", "alert_rate"]
    return joined.select(*SEGMENT, status.alias("status"), F.coalesce("row_count", F.lit(0)).alias("labeled_count"), *[F.when(status == "computed", F.col(m)).alias(m) for m in metrics])


def segment_calibration(labelled: DataFrame, bins: int = 10) -> DataFrame:
    """Calibration bins of each segment whose labelled rows have both classes, empty bins with zeros."""
    rows = labelled.filter("label is not null").select(*SEGMENT, "label", F.col("risk_score").alias("score"))
    both = rows.groupBy(*SEGMENT).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).filter("p > 0 and n > 0").select(*SEGMENT)
    return evaluation.calibration_bins(rows, bins, by=SEGMENT).join(both, list(SEGMENT), "left_semi")


def event_errors(events: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Events with the list of contract rules that they break (``errors``), for quarantine; ``features_json`` is parsed once, in a step of its own."""
    from ..schemas import TRANSACTION_TYPES

    kept, name = events.columns, "_parsed" + "_" * max(map(len, events.columns))  # a name of no other column
    events = events.withColumn(name, F.from_json("features_json", "map<string,string>"))
    parsed = F.col(name)
    keys = F.array_sort(F.coalesce(F.map_keys(parsed), F.array().cast("array<string>")))
    numbers = F.map_filter(parsed, lambda k, v: (k != "transaction_type") & (F.try_to_number(v, F.lit("S999999999999999.999999999")).isNull() & v.try_cast("double").isNull()))
    infinite = F.map_filter(parsed, lambda k, v: (k != "transaction_type") & (F.isnan(v.try_cast("double")) | (F.abs(v.try_cast("double")) == float("inf"))))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    uuid = "^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"
    rules = {
        "schema_version": F.col("schema_version") == "prediction-event-v1", "feedback_id": F.col("feedback_id").rlike(uuid), "event_time": F.col("event_time").isNotNull(),
        **{c: F.length(c).between(1, 128) for c in SEGMENT}, "features": keys == F.array(*[F.lit(f) for f in sorted(features)]),
        "feature_values": (F.size(numbers) == 0) & (F.size(infinite) == 0), "transaction_type": F.try_element_at(parsed, F.lit("transaction_type")).isin(*TRANSACTION_TYPES),
        "risk_score": finite("risk_score") & F.col("risk_score").between(0, 1), "decision_threshold": finite("decision_threshold") & F.col("decision_threshold").between(0, 1),
        "decision": F.col("decision").isin("allow", "review"), "latency_seconds": finite("latency_seconds") & (F.col("latency_seconds") >= 0),
    }
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return events.select(*[F.col(f"`{c}`") for c in kept if c != "errors"], errors.alias("errors"))


def label_errors(labels: DataFrame, as_of: datetime) -> DataFrame:
    """Labels with the rules that they break: version, label 0 or 1, and a time no more than five minutes ahead."""
    rules = {
        "schema_version": F.col("schema_version") == "delayed-label-v1", "feedback_id": F.col("feedback_id").isNotNull(), "label": F.col("label").isin(0, 1),
        "label_time": F.col("label_time") <= F.lit(as_of + timedelta(minutes=5)),
    }
    return labels.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()])))


def settle_labels(labels: DataFrame, order: str = "arrival") -> DataFrame:
    """First write wins: every submission with its outcome: ``accepted``, ``duplicate`` (same label again) or ``conflict``.

    The first submission of an id is its smallest ``order``; it is found by an aggregate and joined back, so an id with
    very many submissions is a skewed join side and not one task's window.
    """
    first = labels.groupBy("feedback_id").agg(F.min(F.struct(order, "label")).alias("first"))
    outcome = F.when(F.col(order) == F.col("first")[order], "accepted").when(F.col("label").eqNullSafe(F.col("first.label")), "duplicate").otherwise("conflict")
    return labels.join(first, "feedback_id").withColumn("outcome", outcome).drop("first")


def decide(scored: DataFrame, threshold: float, score: str = "risk_score") -> DataFrame:
    """``review`` from the threshold upwards, else ``allow``."""
    return scored.withColumn("decision", F.when(F.col(score) >= threshold, "review").otherwise("allow"))
