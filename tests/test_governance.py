"""Summaries that merge, Newton steps, content fingerprints, and the registry's log under two writers."""

import math
import threading
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlens.operators import fingerprint, logistic, summary
from txnlens.sources.registry import Registry

T = datetime(2026, 1, 1)


def test_merged_summaries_are_exact_and_within_stated_error(spark):
    rng = np.random.default_rng(4)
    n = 6000
    values = np.round(rng.lognormal(3, 1, n), 2)
    rows = [(T + timedelta(hours=int(rng.integers(24 * 20))), None if i % 50 == 0 else float("nan") if i % 50 == 1 else float(v), f"c{int(v) % 300}" if i % 7 else None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "at timestamp, v double, c string").withColumn("day", F.lit("clash")).repartition(5)
    daily = summary.daily_summary(df, "at", ["v"], ["c"])
    assert daily.count() == 40
    for first, last in ((None, None), (date(2026, 1, 3), date(2026, 1, 9))):
        got = {r["feature"]: r for r in summary.merge_summaries(daily, first, last, (0.1, 0.5, 0.9)).collect()}
        some = [r for r in rows if (first is None or first <= r[0].date() <= last)]
        v = np.array([x for _, x, _ in some if x is not None and not math.isnan(x)])
        assert (got["v"]["row_count"], got["v"]["null_count"], got["v"]["minimum"], got["v"]["maximum"]) == (len(some), len(some) - len(v), v.min(), v.max())
        assert got["v"]["mean"] == pytest.approx(v.mean()) and got["v"]["deviation"] == pytest.approx(v.std())
        for q, x in zip((0.1, 0.5, 0.9), got["v"]["quantiles"], strict=True):
            assert (v < x).mean() - summary.KLL_ERROR <= q <= (v <= x).mean() + summary.KLL_ERROR
        kinds = {c for _, _, c in some if c}
        for feature, exact in (("v", len(set(v.tolist()))), ("c", len(kinds))):
            assert abs(got[feature]["distinct_estimate"] - exact) <= 3 * summary.HLL_ERROR * exact
        assert got["c"]["null_count"] == sum(c is None for _, _, c in some) and got["c"]["quantiles"] is None and got["c"]["mean"] is None


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([(T, None, None), (None, 1.0, "x")], "at timestamp, v double, c string")
    got = {(r["feature"], r["day_count"]): r for r in summary.merge_summaries(summary.daily_summary(none, "at", ["v"], ["c"]), T.date(), T.date()).collect()}
    assert got["v", 1]["null_count"] == 1 and got["v", 1]["quantiles"] is None and got["v", 1]["distinct_estimate"] == 0
    assert summary.merge_summaries(summary.daily_summary(none.limit(0), "at", ["v"])).count() == 0


def test_newton_steps_equal_plain_ones(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + x @ [1, -2, 0.3])))).astype(int)
    w = rng.integers(1, 4, 400).astype(float)
    df = spark.createDataFrame([(*map(float, r), int(t), float(k)) for r, t, k in zip(x, y, w, strict=True)] + [(None, 1.0, 1.0, 1, 1.0)], "a double, b double, c double, y int, w double").repartition(3)
    for ridge in (0.0, 2.0):
        beta, xx = np.zeros(4), np.c_[np.ones(400), x]
        for _ in range(7):
            p = 1 / (1 + np.exp(-xx @ beta))
            pen = ridge * np.array([0, 1, 1, 1])
            beta = beta + np.linalg.solve((xx * (w * p * (1 - p))[:, None]).T @ xx + np.diag(pen), xx.T @ (w * (y - p)) - pen * beta)
        got = logistic.fit(df, ["a", "b", "c"], "y", 7, ridge, "w")
        assert np.allclose([got.intercept, *got.coefficients], beta) and got.last_move < 1e-6
    scored = got.score(df).orderBy("w").collect()
    assert sum(r["risk_score"] is None for r in scored) == 1 and all(0 < r["risk_score"] < 1 for r in scored if r["a"] is not None)
    with pytest.raises(ValueError):
        logistic.fit(df.limit(0), ["a"], "y")


def test_fingerprint_follows_content_only(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f"t{i % 7}", [i, None], i / 3) for i in range(50)] + [(1, "t1", [1, None], 1 / 3)]
    df = spark.createDataFrame(rows, "id long, t string, l array<long>, v double")
    make = lambda d, **k: fingerprint.manifest({"train": d}, {"x": 1} | k, "now", code="c", time="id")
    a = make(df)
    df.repartition(7).write.parquet(f"{tmp_path}/t")
    assert make(spark.read.parquet(f"{tmp_path}/t").select("v", "id", "l", "t"))["dataset_id"] == a["dataset_id"]
    for other in (df.withColumn("t", F.when(F.col("id") == 9, "z").otherwise(F.col("t"))), df.dropDuplicates(), df.withColumn("t", F.coalesce("t", F.lit("-"))), df.withColumn("l", F.when(F.col("id") != 3, F.col("l")))):
        assert make(other)["dataset_id"] != a["dataset_id"]
    assert make(df, y=2)["dataset_id"] != a["dataset_id"] and a["parts"]["train"]["time_range"] == ["0", "49"]
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "m.py").write_text("x = 1")
    before = fingerprint.code_digest(tmp_path / "code")
    (tmp_path / "code" / "m.py").write_text("x = 2")
    assert fingerprint.code_digest(tmp_path / "code") != before
    swap = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    one, two = (fingerprint.content(swap.filter(c)).first() for c in ("x is null", "y is null"))
    assert one != two and fingerprint.content(swap.limit(0)).first()[:] == (0, "0", "0")


class Saved:
    def save(self, path):
        pass


def test_two_writers_lose_no_move(spark, tmp_path):
    first, second = Registry(spark, str(tmp_path)), Registry(spark, str(tmp_path))
    found, errors = [], []

    def work(r, who):
        try:
            for _ in range(4):
                found.append(r.register("m", Saved(), T, note=who))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(r, w)) for r, w in ((first, "a"), (second, "b"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(found) == list(range(1, 9))
    log = first.log().orderBy("seq").collect()
    assert [e["seq"] for e in log] == list(range(1, 9)) and [e["version"] for e in log] == list(range(1, 9))
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if p.suffix == ".json") == [f"{i:012d}.json" for i in range(1, 9)]


def test_a_failed_promotion_is_undone(spark, tmp_path):
    r = Registry(spark, str(tmp_path))
    for _ in range(3):
        r.register("m", Saved(), T)
    seen = []
    r.promote("m", 1, "live", "me", T, True, then=lambda e: seen.append(e["version"]))

    def fail(_):
        raise OSError("servers are down")

    with pytest.raises(OSError):
        r.promote("m", 2, "live", "me", T, True, then=fail)
    assert r.current("m", "live") == 1 and seen == [1]
    with pytest.raises(ValueError):
        r.rollback("m", "live", "me", T)  # what was undone is no earlier version

    def overtaken(_):
        r.promote("m", 3, "live", "other", T, True)
        raise OSError

    with pytest.raises(OSError):
        r.promote("m", 2, "live", "me", T, True, then=overtaken)
    assert r.current("m", "live") == 3  # another's move stays
    assert [e["action"] for e in r.log().orderBy("seq").collect()][3:] == ["promote", "promote", "undo", "promote", "promote"]
    r.tag("m", 3, "stage", "a", "me", T)
    r.tag("m", 3, "stage", "b", "me", T)
    assert r.tags("m", 3) == {"stage": "b"} and r.rollback("m", "live", "me", T) == 2


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    from txnlens.operators import lineage

    for folder, text in (("a", "1"), ("b", "2")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "x.csv").write_text(text)
    got = lambda path: sorted(r["file"] for r in lineage.file_digests(spark, path).collect())
    assert got(f"{tmp_path}/in") == got(f"file:{tmp_path}/in/") == ["a/x.csv", "b/x.csv"]
    assert got(f"{tmp_path}/in/a/x.csv") == ["x.csv"]
    before = lineage.manifest(spark, f"{tmp_path}/in", [], {}, "now")["dataset_id"]
    (tmp_path / "in/a/x.csv").write_text("2")
    (tmp_path / "in/b/x.csv").write_text("1")
    assert lineage.manifest(spark, f"{tmp_path}/in", [], {}, "now")["dataset_id"] != before
