from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from txnlens.operators import ranks, sampling, split

T0 = datetime(2026, 1, 1)


def hourly(spark, n, step=timedelta(hours=1), same=1):
    rows = [(f"tx-{i:02d}", T0 + step * (i // same), i % 3 == 0) for i in range(n)]
    return spark.createDataFrame([(a, b, int(c)) for a, b, c in rows], "transaction_id string, timestamp timestamp, is_fraud int")


def ids(df):
    return sorted(r["transaction_id"] for r in df.collect())


def test_exact_sizes(spark):
    s = split.split_exact(hourly(spark, 10), 0.70, 0.15, 0.15)
    assert [ids(s[k]) for k in split.SPLITS] == [[f"tx-{i:02d}" for i in range(7)], ["tx-07"], ["tx-08", "tx-09"]]
    assert [split.split_exact(hourly(spark, 6), 0.5, 0.25, 0.25)[k].count() for k in split.SPLITS] == [3, 1, 2]


@pytest.mark.parametrize("same", [1, 4, 20])
def test_exact_equals_the_global_window_with_ties(spark, same):
    df = hourly(spark, 40, timedelta(microseconds=700), same)
    a, b = (f(df, 0.6, 0.2, 0.2) for f in (split.split_exact, split.split_exact_by_window))
    assert all(ids(a[k]) == ids(b[k]) for k in split.SPLITS)


def test_exact_split_plan_has_no_exchange(spark):
    plan = split.split_exact(hourly(spark, 20), 0.6, 0.2, 0.2)["train"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("ratios,what", [((0.7, 0.2, 0.2), "sum to 1.0"), ((0, 0.5, 0.5), "greater than 0")])
def test_bad_ratios(spark, ratios, what):
    with pytest.raises(ValueError, match=what):
        split.split_exact(hourly(spark, 10), *ratios)


def test_time_boundary_ties_go_earlier_and_fall_back(spark):
    s = split.split_by_time(hourly(spark, 12, same=3), 0.5, 0.25, 0.25, error=0.0)
    assert [s[k].count() for k in split.SPLITS] == [6, 3, 3]
    s = split.split_by_time(hourly(spark, 12, same=12), 0.5, 0.25, 0.25, error=0.0)  # one time only
    assert [s[k].count() for k in split.SPLITS] == [6, 3, 3]


def test_validate_splits(spark):
    df = hourly(spark, 20)
    s = split.split_exact(df, 0.6, 0.2, 0.2)
    assert split.validate_splits(df, s)["total_row_count"] == 20
    with pytest.raises(ValueError, match="invalid splits"):
        split.validate_splits(df, s | {"test": s["validation"]})
    with pytest.raises(ValueError, match="empty"):
        split.validate_splits(df, s | {"test": s["test"].limit(0)})
    assert {r["pair"]: r["overlap_count"] for r in split.overlaps(s | {"test": s["validation"]}).collect()} == {"train__validation": 0, "train__test": 0, "validation__test": 4}


def test_findings_of_a_split(spark):
    df = hourly(spark, 20)
    s = split.split_exact(df, 0.6, 0.2, 0.2)
    r = split.split_findings(df, s | {"test": s["validation"]}).first()
    assert (r["total_row_count"], r["duplicate_transaction_id_count"], r["train_row_count"], r["test_row_count"]) == (20, 4, 12, 4) and r["test_max_timestamp"] == r["validation_max_timestamp"]
    r = split.split_findings(df, s | {"test": s["test"].limit(0)}).first()
    assert r["test_row_count"] == 0 and r["test_min_timestamp"] is None
    r = split.split_findings(df, s | {"train": s["train"].withColumn("is_fraud", F.lit(2))}).first()
    assert (r["train_invalid_target_count"], r["test_invalid_target_count"]) == (12, 0)


def test_time_boundary_within_its_error(spark):
    n, error = 5000, 0.01
    df = spark.range(n).selectExpr("cast(id as string) as transaction_id", "timestamp_seconds(id * 7919 % 5000) as timestamp", "0 as is_fraud")
    s = split.split_by_time(df, 0.7, 0.15, 0.15, error=error)
    counts = [s[k].count() for k in split.SPLITS]
    assert sum(counts) == n and abs(counts[0] - 0.7 * n) <= error * n and abs(counts[0] + counts[1] - 0.85 * n) <= error * n
    split.validate_splits(df, s)


def test_sample_in_order(spark):
    df = spark.createDataFrame([(f"t{i}", (i * 37) % 100) for i in range(100)], "transaction_id string, at int")
    got = sorted((r["row_index"], r["at"], r["transaction_id"]) for r in sampling.sample_in_order(df, 30, 42, "at").collect())
    assert [g[0] for g in got] == list(range(30)) and [g[1] for g in got] == sorted(g[1] for g in got)
    assert {g[2] for g in got} == set(ids(sampling.first_by_hash(df, 30, 42)))
    assert [r["row_index"] for r in sampling.sample_in_order(df, 200, 1, "at").orderBy("at").collect()] == list(range(100))
    assert sampling.sample_in_order(df.limit(0), 5, 1, "at").count() == 0
    with pytest.raises(ValueError):
        sampling.sample_in_order(df, 0, 1, "at")


def test_keep_positives(spark):
    df = spark.createDataFrame([(f"t{i}", int(i in (3, 8))) for i in range(10)], "transaction_id string, is_fraud int")
    (a, summary), (b, _) = (sampling.keep_positives(df, "is_fraud", 5, 42) for _ in range(2))
    assert ids(a) == ids(b) and a.filter("is_fraud = 1").count() == 2 and a.count() == 5 and summary.sampled_negative_count == 3
    over, _ = sampling.keep_positives(df, "is_fraud", 1, 42)
    assert ids(over) == ["t3", "t8"]
    assert sampling.keep_positives(df, "is_fraud", 100, 42)[0] is df
    with pytest.raises(ValueError, match="nulls"):
        sampling.keep_positives(df.withColumn("is_fraud", F.lit(None).cast("int")), "is_fraud", 5, 42)


def test_caps(spark, monkeypatch):
    df = spark.createDataFrame([(f"t{i}", int(i < 4)) for i in range(200)], "transaction_id string, is_fraud int")
    out, summary = sampling.cap_rows(df, "is_fraud", 50, 42)
    assert out.count() == 50 == summary.sampled_row_count and ids(out) == ids(sampling.first_by_rank(df, 50, 42))
    monkeypatch.setattr(ranks, "SMALL", 3)  # several descent steps
    assert ids(sampling.first_by_hash(df, 50, 42)) == ids(out)
    hashed, _ = sampling.cap_rows(df, "is_fraud", 50, 42, "hash")
    assert 20 < hashed.count() < 90
    with pytest.raises(ValueError):
        sampling.cap_rows(df, "is_fraud", 0, 42)


def test_samples_of_repeated_keys_are_exact(spark):
    df = spark.createDataFrame([(f"t{i % 10}", int(i == 0)) for i in range(30)], "transaction_id string, is_fraud int")
    for n in (1, 10, 29):
        assert sampling.first_by_hash(df, n, 42).count() == n
    out, summary = sampling.keep_positives(df, "is_fraud", 10, 42)
    assert out.count() == 10 == summary.sampled_row_count and out.filter("is_fraud = 1").count() == 1


@pytest.mark.parametrize("n,k", [(100, 7), (100, 99), (10, 10), (97, 13)])
def test_strided(spark, n, k):
    df = spark.range(n).select(F.col("id").cast("int").alias("v"))
    assert sorted(r["v"] for r in sampling.strided(df, k, "v").collect()) == [int(i * n / k) for i in range(k)]


def test_dispatch(spark):
    df = hourly(spark, 9)
    assert sampling.sample_split(df, "train", "is_fraud", 5, 1, "none")[0] is df
    assert sampling.sample_split(df, "test", "is_fraud", 5, 1, "exact")[0].count() == 5
    with pytest.raises(ValueError):
        sampling.sample_split(df, "test", "is_fraud", 5, 1, "none")


def test_kth_text_by_bytes(spark, monkeypatch):
    """Texts that are no hexadecimal keys: of any length and alphabet, prefixes of each other, repeated, empty."""
    monkeypatch.setattr(ranks, "SMALL", 2)
    texts = ["", "", "a", "aa", "aaa", "aaaaa", "aaaaaé", "aaaaa😀", "aaaaa\uffff", "é", "éé", "éa", "😀", "\uffff", "Z", "zz"] * 2
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    want = sorted(texts, key=lambda t: t.encode())
    for k in (1, 4, 5, 9, 14, 17, 20, 23, 26, 29, 32):
        assert ranks.kth_text(df, F.col("t"), k) == want[k - 1]
