import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from txnlens.operators import metrics, monitoring as mon
from txnlens.plans.contract import MODEL_FEATURES

NOW = datetime(2026, 3, 1)


def frames(spark):
    events = [("e0", NOW - timedelta(hours=1), 0.9), ("e1", NOW - timedelta(hours=2), 0.1), ("e2", NOW - timedelta(days=10), 0.2)]
    labels = [("e0", 1, NOW - timedelta(minutes=5)), ("e1", 0, NOW - timedelta(minutes=4)), ("nobody", 1, NOW - timedelta(minutes=3))]
    e = spark.createDataFrame([(i, t, "m", "1", "pre-transaction-v1", s, 0.5) for i, t, s in events], "feedback_id string, event_time timestamp, model_name string, model_version string, feature_contract_version string, risk_score double, decision_threshold double")
    return e, spark.createDataFrame(labels, "feedback_id string, label int, label_time timestamp")


def test_snapshot(spark):
    rows, counters = mon.snapshot(*frames(spark), NOW, 30, 90, 7, 100)
    assert counters.first().asDict() == {"event_count": 3, "joined_label_count": 2, "unmatched_label_count": 1, "late_unlabeled_count": 1, "truncated": False}
    assert [r["feedback_id"] for r in rows.collect()] == ["e2", "e1", "e0"]
    rows, counters = mon.snapshot(*frames(spark), NOW, 30, 90, 7, 2)
    assert counters.first()["truncated"] and [r["feedback_id"] for r in rows.collect()] == ["e1", "e0"]


def test_label_before_its_event_does_not_count(spark):
    e, _ = frames(spark)
    early = spark.createDataFrame([("e0", 1, NOW - timedelta(hours=2))], "feedback_id string, label int, label_time timestamp")
    assert mon.labelled_events(e, early).filter("label is not null").count() == 0 and mon.unmatched_labels(e, early).count() == 1


def test_segments(spark):
    rows = mon.labelled_events(*frames(spark))
    same = {"model_name": "m", "model_version": "1", "feature_contract_version": "pre-transaction-v1"}
    status = lambda *a: mon.segments(*a).first()["drift_status"]
    assert status(rows, same) == "generated" and status(rows, same, False) == "reference_unavailable"
    assert status(rows, same | {"model_version": "2"}) == "skipped_reference_model_mismatch" and status(rows, None) == "skipped_reference_model_mismatch"
    assert status(rows.filter("feedback_id = 'e0'"), same) == "insufficient_current_rows"
    r = mon.segment_performance(rows).first()
    assert (r["status"], r["labeled_count"], r["precision"], r["recall"]) == ("computed", 2, 1, 1)
    assert mon.segment_performance(rows.filter("feedback_id = 'e0'")).first()["status"] == "awaiting_both_label_classes"
    assert mon.segment_performance(rows.filter("feedback_id = 'e2'")).first()["status"] == "awaiting_labels"


def test_segment_drift_fails_alone(spark):
    import math

    inf = float("inf")
    data = [("good", i, x, 1.0) for i, x in enumerate([1.0, 2.0, 9.0, None])] + [("odd", i, x, 1.0) for i, x in enumerate([1.0, inf])] + [("none", i, None, 1.0) for i in range(3)] + [("one", 0, 1.0, 1.0), (None, 0, 1.0, 1.0), (None, 1, 4.0, 1.0)]
    rows = spark.createDataFrame([("m", v, "c", f"{v}{i}", None, x, y) for v, i, x, y in data], "model_name string, model_version string, feature_contract_version string, feedback_id string, label int, x double, y double")
    reference = spark.createDataFrame([(1.0, None), (8.0, None), (None, None)], "x double, y double")
    edges = {"x": [5.0], "y": [0.5]}
    got = {}
    for v in ("good", "odd", "none", "one", "other"):
        of = {"model_name": "m", "model_version": v, "feature_contract_version": "c"}
        for r in mon.segment_drift(rows, reference, of, ["x"], edges).collect():
            if r["model_version"] == v or v == "other":
                got[v, r["model_version"]] = (r["drift_status"], r["drift_error_stage"], r["drift_error"], r["psi"])
    c, f = (1.5 / 4, 2.5 / 4), (1.5 / 3, 1.5 / 3)
    assert abs(got["good", "good"][3] - sum((a - b) * math.log(a / b) for a, b in zip(c[::-1], f))) < 1e-12
    assert got["good", "good"][:3] == ("generated", None, None)
    assert got["odd", "odd"] == ("failed", "prepare_data", "InvalidNumber", None) and got["none", "none"] == ("failed", "prepare_data", "MissingFeature", None)
    assert got["one", "one"][0] == "insufficient_current_rows" and {r[0] for k, r in got.items() if k[0] == "other"} == {"skipped_reference_model_mismatch"} and ("other", None) in got
    of = {"model_name": "m", "model_version": "good", "feature_contract_version": "c"}
    two = [r for r in mon.segment_drift(rows, reference, of, ["x", "y"], edges).collect() if r["model_version"] == "good"]
    assert {(r["feature"], r["drift_status"], r["drift_error_stage"], r["drift_error"], r["psi"]) for r in two} == {("x", "failed", "run_report", "MissingReference", None), ("y", "failed", "run_report", "MissingReference", None)}
    assert {r["drift_status"] for r in mon.segment_drift(rows, reference.limit(0), of, ["x"], edges).filter("model_version = 'good'").collect()} == {"reference_unavailable"}
    assert mon.segment_drift(rows.limit(0), reference, of, ["x"], edges).count() == 0


def test_slug(spark):
    values = ["a b/c", "--..", "x" * 100, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(mon.slug(F.col("v"))).collect()]
    assert got == ["a-b-c", "unknown", "x" * 80, "unknown"]


def test_first_label_wins(spark):
    rows = [("a", 1, i) for i in range(16)] + [("b", 0, 1), ("b", 1, 2), ("b", 0, 3)]
    got = mon.settle_labels(spark.createDataFrame(rows, "feedback_id string, label int, arrival int"))
    counts = {(r["feedback_id"], r["outcome"]): r["count"] for r in got.groupBy("feedback_id", "outcome").count().collect()}
    assert counts == {("a", "accepted"): 1, ("a", "duplicate"): 15, ("b", "accepted"): 1, ("b", "conflict"): 1, ("b", "duplicate"): 1}


def test_event_contract(spark):
    good = {k: 1.0 for k in MODEL_FEATURES} | {"transaction_type": "PAYMENT"}
    base = ("123e4567-e89b-12d3-a456-426614174000", "prediction-event-v1", NOW, "m", "1", "c", json.dumps(good), 0.5, 0.5, "review", 0.1)
    bad = {
        "features": base[:6] + (json.dumps({k: v for k, v in good.items() if k != "amount"}),) + base[7:],
        "transaction_type": base[:6] + (json.dumps(good | {"transaction_type": "X"}),) + base[7:],
        "feature_values": base[:6] + (json.dumps(good | {"amount": "much"}),) + base[7:],
        "risk_score": base[:7] + (1.5,) + base[8:], "decision": base[:9] + ("maybe",) + base[10:], "feedback_id": ("x",) + base[1:], "event_time": base[:2] + (None,) + base[3:],
    }
    ddl = "feedback_id string, schema_version string, event_time timestamp, model_name string, model_version string, feature_contract_version string, features_json string, risk_score double, decision_threshold double, decision string, latency_seconds double"
    got = [r["errors"] for r in mon.event_errors(spark.createDataFrame([base, *bad.values()], ddl), MODEL_FEATURES).collect()]
    assert got[0] == [] and [k in e for k, e in zip(bad, got[1:])] == [True] * len(bad)
    clash = mon.event_errors(spark.createDataFrame([base], ddl).withColumns({"_parsed": F.lit(1), "errors": F.lit(2)}), MODEL_FEATURES)
    assert clash.columns == [*ddl.replace(" string", "").replace(" double", "").replace(" timestamp", "").split(", "), "_parsed", "errors"] and clash.first()["errors"] == []
    assert clash._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    labels = spark.createDataFrame([("a", "delayed-label-v1", 1, NOW), ("a", "delayed-label-v1", 2, NOW), ("a", "v0", 1, NOW + timedelta(minutes=6))], "feedback_id string, schema_version string, label int, label_time timestamp")
    assert [r["errors"] for r in mon.label_errors(labels, NOW).collect()] == [[], ["label"], ["schema_version", "label_time"]]


def test_counters_and_quantiles(spark):
    at = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    samples = spark.createDataFrame([("a", at(0), 5.0), ("a", at(60), 8.0), ("a", at(120), 2.0), ("a", at(400), 4.0)], "s string, ts timestamp, value double")
    got = {r["window_start"]: r["increase"] for r in metrics.counter_rate(samples, ["s"]).collect()}
    assert got == {at(0): 5.0, at(300): 2.0}
    e = spark.createDataFrame([(at(i), 0.2 if i < 18 else 0.7, i % 10 == 0) for i in range(20)], "ts timestamp, v double, bad boolean")
    r = metrics.histogram_quantile(e, "v", 0.95).first()
    assert r["requests"] == 20 and abs(r["quantile"] - 0.75) < 1e-9
    assert metrics.histogram_quantile(e.withColumn("v", F.lit(9.0)), "v").first()["quantile"] == 5.0
    ratios = metrics.error_ratio(e, F.col("bad"), "10 seconds").select("errors", "ratio").collect()
    assert [tuple(r) for r in ratios] == [(1, 0.1), (1, 0.1)]


def test_alerts_hold_over_midnight_and_not_over_gaps(spark):
    at = lambda m: datetime(2026, 1, 1, 23, 40) + timedelta(minutes=m)
    flags = {0: True, 5: True, 10: False, 15: True, 20: True, 25: True, 30: None, 35: True, 45: True, 50: True, 55: True, 2885: True}
    rows = [(s, at(m), f) for s in "ab" for m, f in flags.items()]
    got = metrics.alert_states(spark.createDataFrame(rows, "s string, window_start timestamp, firing boolean"), "10 minutes", "5 minutes", ["s"])
    want = {0: (0, "pending"), 5: (0, "pending"), 10: (None, "inactive"), 15: (15, "pending"), 20: (15, "pending"), 25: (15, "firing"), 30: (None, "inactive"), 35: (35, "pending"), 45: (45, "pending"), 50: (45, "pending"), 55: (45, "firing"), 2885: (2885, "pending")}
    assert {(r["s"], r["window_start"]): (r["active_since"], r["state"]) for r in got.collect()} == {(s, at(m)): (None if a is None else at(a), st) for s in "ab" for m, (a, st) in want.items()}
    whole_days = [(at(5 * i), True) for i in range(1000)]  # an alert of several days
    got = metrics.alert_states(spark.createDataFrame(whole_days, "window_start timestamp, firing boolean"), "10 minutes", "5 minutes")
    assert got.filter(F.col("active_since") == at(0)).count() == 1000 and got.filter("state = 'firing'").count() == 998


def test_overlapping_windows_come_from_panes(spark):
    rng = random.Random(1)
    rows = [("ab"[rng.random() < 0.5], datetime(2026, 1, 1) + timedelta(seconds=rng.randrange(4000)), float(rng.randrange(9))) for _ in range(300)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, value double")
    panes = metrics.windowed(df, ["s"], {"n": F.count(F.lit(1)), "v": F.sum("value")}, "5 minutes", "ts", "1 minute")
    assert "Expand" not in panes._jdf.queryExecution().executedPlan().toString()
    copies = df.groupBy(F.window("ts", "5 minutes", "1 minute").alias("w"), "s").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select("w.start", "s", "n", "v")
    assert sorted(map(tuple, panes.collect())) == sorted(map(tuple, copies.collect()))
    uneven = metrics.windowed(df, ["s"], {"n": F.count(F.lit(1))}, "5 minutes", "ts", "2 minutes")
    assert uneven.agg(F.sum("n")).first()[0] > 600


def test_extrapolated_rate_by_hand(spark):
    at = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    rows = [("a", at(30 + 60 * i), 100.0 + 6 * i) for i in range(5)] + [("b", at(100), 1.0), ("b", at(130), 2.0), ("b", at(160), 0.5)] + [("c", at(10), 7.0), ("d", at(290), 1.0), ("d", at(310), 4.0), ("d", at(340), 5.0)]
    got = {(r["s"], r["window_start"]): (r["samples"], round(r["increase"], 9)) for r in metrics.extrapolated_rate(spark.createDataFrame(rows, "s string, ts timestamp, value double"), ["s"]).collect()}
    # a: 24 in 240 s, borders 30 s away. b: 1.5 in 60 s, 15 s before and after; from zero it takes 40 s. d: the sample before the window is not of it
    assert got == {("a", at(0)): (5, 30.0), ("b", at(0)): (3, 1.5 * 90 / 60), ("d", at(300)): (2, round(55 / 30, 9))}
