import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from txnlens.operators import monitoring, windows
from txnlens.streaming import events as st
from txnlens.streaming import state

T0 = datetime(2026, 1, 1)
EVENTS = "feedback_id string, event_time timestamp"
LABELS = "feedback_id string, label int, label_time timestamp"
MOVES = "transaction_id string, origin_account_id string, destination_account_id string, timestamp timestamp, amount double"


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    state.use_rocksdb(spark)
    yield
    spark.conf.set(key, before)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return st.read_stream(spark, path, spark.createDataFrame([], schema).schema, 1000)


def run(df, out, checkpoint):
    """What is there, to its end; the query's last progress."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.lastProgress


def test_overdue_and_unmatched_equal_the_batch_after_a_restart(spark, rocksdb, tmp_path):
    rng = random.Random(3)
    events = [(f"e{i}", T0 + timedelta(hours=rng.randrange(24 * 10))) for i in range(60)]
    labels = [(f, i % 2, at + timedelta(hours=rng.choice([0, 5, 100, -3]))) for i, (f, at) in enumerate(events[:40])] + [(f"x{i}", 1, T0 + timedelta(hours=i * 9)) for i in range(12)]
    late = [("e50", 1, events[50][1] + timedelta(days=9))]  # after its grace
    end = T0 + timedelta(days=25)
    e, y, out, c = (f"{tmp_path}/{n}" for n in ("e", "y", "out", "c"))
    query = lambda: state.reconcile(stream(spark, e, EVENTS), stream(spark, y, LABELS), grace=timedelta(days=7), lateness=timedelta(days=2), keep=timedelta(days=20))
    by_time = sorted(events, key=lambda r: r[1])
    for k, mark in ((slice(0, 30), T0 + timedelta(days=4)), (slice(30, 60), end)):  # two runs; what is late within the lateness comes in any order
        if k.start == 0:
            put(spark, e, by_time[k], EVENTS)
            put(spark, y, [r for r in labels if r[2] <= mark], LABELS)
        else:
            put(spark, e, [*by_time[k], *by_time[:5]], EVENTS)  # five come again
            put(spark, y, [r for r in labels if r[2] > T0 + timedelta(days=4)], LABELS)
        run(query(), out, c)
    for name in ("end0", "end00"):  # the watermark passes the grace of e50, and applies to the batch after
        put(spark, e, [(name, T0 + timedelta(days=19.5))], EVENTS)
        put(spark, y, [(name, 1, T0 + timedelta(days=19.5))], LABELS)
        run(query(), out, c)
    put(spark, y, late, LABELS)
    run(query(), out, c)
    for path, row, schema in ((e, ("end", end), EVENTS), (y, ("end", 1, end), LABELS)):
        put(spark, path, [row], schema)
    run(query(), out, c)
    put(spark, e, [("end2", end)], EVENTS)  # the watermark of the batch before applies
    run(query(), out, c)
    got = [r.asDict() for r in spark.read.parquet(out).collect() if not r["feedback_id"].startswith("end")]
    batch_e, batch_y = spark.createDataFrame(events, EVENTS), spark.createDataFrame([*labels, *late], LABELS)
    as_of = end - timedelta(days=2)
    joined = {(r["feedback_id"], r["event_time"]) for r in got if r["outcome"] == "joined"}
    overdue = {(r["feedback_id"], r["event_time"]) for r in got if r["outcome"] == "overdue"}
    assert ("e50", events[50][1]) in overdue & joined
    assert overdue - joined == {(r["feedback_id"], r["event_time"]) for r in monitoring.overdue_events(batch_e, batch_y, as_of, 7).collect()}
    want = sorted((r["feedback_id"], r["label_time"], r["label"]) for r in monitoring.unmatched_labels(batch_e, batch_y).collect())
    assert sorted((r["feedback_id"], r["label_time"], r["label"]) for r in got if r["outcome"] == "unmatched") == want and len(want) > 12


def test_labels_settle_and_expire(spark, rocksdb, tmp_path):
    path, out, c = (f"{tmp_path}/{n}" for n in ("in", "out", "c"))
    query = lambda: state.settle_labels(stream(spark, path, LABELS), keep=timedelta(days=3), lateness=timedelta(hours=1))
    most = []
    for day in range(8):  # 50 new ids a day, and the first again
        at = T0 + timedelta(days=day)
        put(spark, path, [(f"d{day}-{i}", i % 2, at) for i in range(50)] + [("d0-0", day % 2, at), ("d0-1", None, at)], LABELS)
        most.append(run(query(), out, c)["stateOperators"][0]["numRowsTotal"])
    assert max(most) <= 50 * 6 * 3 and most[-1] <= most[4] + 3  # each id has its label and a timer, by two indexes; it doesn't grow with the days
    got = sorted((r["label_time"].day, r["outcome"]) for r in spark.read.parquet(out).filter("feedback_id = 'd0-0'").collect())
    assert got[:4] == [(1, "accepted"), (1, "duplicate"), (2, "conflict"), (3, "duplicate")] and "accepted" in [o for _, o in got[4:]]


def test_velocity_equals_the_batch_windows_with_late_rows(spark, rocksdb, tmp_path):
    rng = random.Random(5)
    rows = [(str(i), f"A{i % 3}", "D", T0 + timedelta(seconds=rng.randrange(4 * 86400), milliseconds=rng.randrange(1000)), None if i % 17 == 0 else float(rng.randrange(1000)) / 4) for i in range(400)]
    rows.sort(key=lambda r: r[3])
    rows = [r for _, r in sorted(enumerate(rows), key=lambda x: x[0] + rng.randrange(30))]  # out of order, by some hours
    rows += [("s", "A0", "D", T0 + timedelta(days=3), 5.0), ("s", "A0", "D", T0 + timedelta(days=3), 6.0)]
    path, out, c = (f"{tmp_path}/{n}" for n in ("in", "out", "c"))
    query = lambda: state.velocity(stream(spark, path, MOVES), lateness=timedelta(days=1))
    for k in range(0, len(rows), 101):
        put(spark, path, rows[k : k + 101], MOVES)
        run(query(), out, c)
    put(spark, path, [("end", "Z", "D", T0 + timedelta(days=9), 0.0)], MOVES)
    run(query(), out, c)
    put(spark, path, [("end", "Z", "D", T0 + timedelta(days=9), 0.0)], MOVES)
    run(query(), out, c)
    batch = windows.add_behavior_features(spark.createDataFrame(rows, MOVES))
    want = sorted((r["origin_account_id"], r["timestamp"], -1 if r["amount"] is None else r["amount"], r["transactions_last_24h"], r["amount_sum_last_24h"]) for r in batch.collect())
    got = sorted((r["account"], r["timestamp"], -1 if r["amount"] is None else r["amount"], r["transactions"], r["amount_sum"]) for r in spark.read.parquet(out).filter("account != 'Z'").collect())
    assert got == want


def test_velocity_of_one_busy_account(spark, rocksdb, tmp_path):
    """100,000 rows of one account in one batch: each costs a binary search."""
    path, out, c = (f"{tmp_path}/{n}" for n in ("in", "out", "c"))
    at = (F.lit(T0).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id") % 86400)).alias("timestamp")
    spark.range(100_000).select(F.col("id").cast("string").alias("transaction_id"), F.lit("A").alias("origin_account_id"), F.lit("D").alias("destination_account_id"), at, F.lit(1.0).alias("amount")).coalesce(1).write.parquet(path)
    put(spark, path, [("e", "Z", "D", T0 + timedelta(days=9), 0.0)], MOVES)
    query = lambda: state.velocity(stream(spark, path, MOVES))
    run(query(), out, c)
    put(spark, path, [("e", "Z", "D", T0 + timedelta(days=9), 0.0)], MOVES)
    last = run(query(), out, c)
    got = spark.read.parquet(out).filter("account = 'A'")
    assert got.count() == 100_000 and got.agg(F.max("transactions"), F.max("amount_sum")).first()[:] == (99_999, 99_999.0)
    assert last["stateOperators"][0]["numRowsTotal"] < 30  # nine days later nothing of it is left
