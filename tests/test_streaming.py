from datetime import datetime, timedelta

from pyspark.sql import functions as F

from txnlens.streaming import events as st

T0 = datetime(2026, 1, 1)
EVENTS = "feedback_id string, event_time timestamp, risk_score double"


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return df.sparkSession.table(name).collect()
    finally:
        q.stop()


def test_dedupe_and_idempotent_sink(spark, tmp_path):
    path = f"{tmp_path}/in"
    put(spark, path, [("a", T0, 0.1), ("a", T0, 0.1), ("b", T0, 0.2)], EVENTS)
    schema = spark.read.parquet(path).schema
    assert sorted(r["feedback_id"] for r in drain(st.dedupe_events(st.read_stream(spark, path, schema)), "dedupe")) == ["a", "b"]
    for checkpoint in ("c1", "c2"):  # the second reads everything again
        st.write_events(st.read_stream(spark, path, schema), f"{tmp_path}/out", f"{tmp_path}/{checkpoint}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_delayed_join_and_rate(spark, tmp_path):
    put(spark, f"{tmp_path}/e", [("a", T0, 0.9), ("b", T0, 0.1)], EVENTS)
    put(spark, f"{tmp_path}/l", [("a", 1, T0 + timedelta(days=1)), ("b", 1, T0 + timedelta(days=30))], "feedback_id string, label int, label_time timestamp")
    e = st.read_stream(spark, f"{tmp_path}/e", spark.read.parquet(f"{tmp_path}/e").schema)
    labels = st.read_stream(spark, f"{tmp_path}/l", spark.read.parquet(f"{tmp_path}/l").schema)
    assert ("a", 1) in [(r["feedback_id"], r["label"]) for r in drain(st.join_labels(e, labels), "joined")]
    put(spark, f"{tmp_path}/e", [("c", T0 + timedelta(hours=2), 0.5)], EVENTS)
    got = drain(st.windowed_rate(st.read_stream(spark, f"{tmp_path}/e", spark.read.parquet(f"{tmp_path}/e").schema, 1), F.col("risk_score") > 0.5), "rate")
    assert [(r["requests"], r["errors"]) for r in got] == [(2, 1)]


def test_console(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [("watched", T0, 0.1)], EVENTS)
    rows = st.read_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    q = st.write_console(rows, f"{tmp_path}/c")
    q.awaitTermination()
    assert q.exception() is None and q.recentProgress[-1]["sink"]["description"].startswith("org.apache.spark.sql.execution.streaming.") and sum(p["numInputRows"] for p in q.recentProgress) == 1
