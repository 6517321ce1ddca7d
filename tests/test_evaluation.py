import pytest

from txnlens.operators import drift, evaluation as ev, gates


def scored(spark, labels, scores, model="m"):
    return spark.createDataFrame([(model, y, float(s)) for y, s in zip(labels, scores)], "model string, label int, score double")


BASIC = ([0, 0, 1, 1], [0.05, 0.40, 0.60, 0.90])


def test_metrics_at_half(spark):
    r = ev.confusion(scored(spark, *BASIC), 0.5).first()
    assert [r[k] for k in ("precision", "recall", "f1", "alert_rate", "true_negatives", "false_positives", "false_negatives", "true_positives")] == [1, 1, 1, 0.5, 2, 0, 0, 2]
    assert r["brier_score"] == pytest.approx(0.083125)
    r = ev.confusion(scored(spark, *BASIC), 0.8).first()
    assert (r["precision"], r["recall"]) == (1, 0.5) and r["f1"] == pytest.approx(2 / 3)
    r = ev.ranking_metrics(scored(spark, *BASIC)).first()
    assert (r["roc_auc"], r["pr_auc"]) == (1, 1)


def test_ranking_with_ties(spark):
    y, s = [1, 0, 1, 0, 0, 1], [0.9, 0.9, 0.5, 0.5, 0.1, 0.1]
    pairs = [(a > b) + 0.5 * (a == b) for a, la in zip(s, y) if la for b, lb in zip(s, y) if not lb]
    r = ev.ranking_metrics(scored(spark, y, s)).first()
    assert r["roc_auc"] == pytest.approx(sum(pairs) / len(pairs)) and r["pr_auc"] == pytest.approx((1 / 2 + 2 / 4 + 3 / 6) / 3)
    assert ev.ranking_metrics(scored(spark, [0, 0], [0.1, 0.2])).first()["roc_auc"] is None


def test_sweep_equals_confusion(spark):
    df = scored(spark, *BASIC)
    for r in ev.threshold_sweep(df, [0.0, 0.4, 0.5, 0.8, 1.0], 1, 5).collect():
        c = ev.confusion(df, r["threshold"]).first()
        assert all(r[k] == pytest.approx(c[k]) for k in c.asDict())
    assert [r["expected_cost"] for r in ev.threshold_sweep(df, [0.5, 0.8], 1, 5).orderBy("threshold").collect()] == [0, 5]
    assert ev.best_threshold(ev.threshold_sweep(df, [0.5, 0.8], 1, 5), "business_cost").first()["threshold"] == 0.5
    for bad in ([], [0.5, 0.5], [0.8, 0.5], [1.5]):
        with pytest.raises(ValueError):
            ev.threshold_sweep(df, bad)


def test_calibration(spark):
    bins = ev.calibration_bins(scored(spark, [0, 1, 1], [0.1, 0.8, 0.9]), 4).orderBy("bin").collect()
    assert [b["row_count"] for b in bins] == [1, 0, 0, 2]
    edge = ev.calibration_bins(scored(spark, [0, 1], [0.3, 1.0]), 10).filter("row_count > 0").orderBy("bin").collect()
    assert [b["bin"] for b in edge] == [2, 9]  # the third edge is 0.30000000000000004
    df = spark.createDataFrame([("m", 9, 0.1, 0.0), ("m", 1, 0.9, 1.0)], "model string, row_count long, mean_predicted_probability double, observed_positive_rate double")
    assert ev.calibration_error(df).first()["calibration_error"] == pytest.approx(0.10)


def test_class_weights(spark):
    r = ev.class_weights(scored(spark, [0, 0, 0, 1], [0.1] * 4)).first()
    assert (r["positive_rate"], r["positive_weight"], r["scale_pos_weight"]) == (0.25, 2, 3) and r["negative_weight"] == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        ev.class_weights(scored(spark, [0, None], [0.1, 0.1]))


def test_candidates(spark):
    both = scored(spark, *BASIC, "zeta").union(scored(spark, *BASIC, "alpha"))
    chosen = ev.best_threshold(ev.threshold_sweep(both, [0.8])).join(ev.ranking_metrics(both), "model")
    assert [r["model"] for r in ev.rank_candidates(chosen).orderBy("place").collect()] == ["alpha", "zeta"]
    sweep = ev.threshold_sweep(both, [0.8])
    assert ev.best_threshold(sweep, minimum_recall=0.9).count() == 0
    assert {r["model"]: r["maximum_recall"] for r in ev.rejected_candidates(sweep, 0.9).collect()} == {"alpha": 0.5, "zeta": 0.5}


@pytest.mark.parametrize("labels,scores", [([0, 0], [0.1, 0.2]), ([0, 1], [0.1, float("nan")]), ([0, 2], [0.1, 0.2]), ([0, 1], [0.1, 1.2]), ([], [])])
def test_check_scores(spark, labels, scores):
    with pytest.raises(ValueError):
        ev.check_scores(scored(spark, labels, scores))


def gate(spark, recall=0.9, cost=0.015):
    names = {"pr_auc": 0.9, "precision": 0.8, "recall": recall, "expected_cost_per_transaction": cost, "brier_score": 0.05, "calibration_error": 0.03, "alert_rate": 0.01}
    old = names | {"recall": 0.9, "expected_cost_per_transaction": 0.01, "calibration_error": 0.02}
    row = {f"test_{k}": v for k, v in names.items()} | {f"validation_{k}": names[k] for k in ("pr_auc", "precision", "recall")} | {f"incumbent_{k}": v for k, v in old.items()}
    row |= {"model": "m", "schema_contract_passed": True, "duplicate_transaction_id_count": 0, "split_overlap_count": 0, "test_row_count": 10000, "test_positive_count": 100}
    rows = gates.quality_gate(spark.createDataFrame([tuple(row.values())], list(row)))
    return rows, gates.gate_status(rows).first()


def test_gate(spark):
    rows, status = gate(spark)
    assert rows.count() == 22 and (status["status"], status["failed_checks"]) == ("passed", [])
    _, status = gate(spark, 0.7, 0.03)
    assert status["status"] == "rejected" and {"validation.recall", "test.recall", "comparison.expected_cost_per_transaction_increase"} <= set(status["failed_checks"])


def test_drift(spark):
    a, b = spark.range(100).selectExpr("cast(id as double) as x"), spark.range(100).selectExpr("cast(id + 50 as double) as x")
    assert drift.ks(a, a, ["x"]).first()["ks"] == 0 and drift.ks(a, b, ["x"]).first()["ks"] == pytest.approx(0.5)
    assert drift.psi(a, a, ["x"]).first()["psi"] == pytest.approx(0) and drift.psi(a, b, ["x"]).first()["psi"] > 0.25


def test_ranges_change_nothing(spark):
    """Ranking and KS over many ranges equal all pairs and the plain gaps, with null groups and skewed values."""
    from pyspark.sql import functions as F

    df = spark.range(400).select(
        F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("model"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("label"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(97)) / 97).alias("score")
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        got = {r["model"]: r for r in ev.ranking_metrics(df).collect()}
        gap = drift.ks(df.filter("model = 1"), df.filter("model = 2"), ["score"]).first()["ks"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = df.collect()
    assert set(got) == {None, 1, 2, 3}
    for m, r in got.items():
        pos, neg = ([x["score"] for x in rows if x["model"] == m and x["label"] == y] for y in (1, 0))
        auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
        ap = sum(sum(p >= s for p in pos) / sum(p >= s for p in pos + neg) for s in pos) / len(pos)
        assert r["roc_auc"] == pytest.approx(auc) and r["pr_auc"] == pytest.approx(ap)
    one, two = ([x["score"] for x in rows if x["model"] == m] for m in (1, 2))
    assert gap == pytest.approx(max(abs(sum(v <= x for v in one) / len(one) - sum(v <= x for v in two) / len(two)) for x in one + two))


def test_place(spark):
    from pyspark.sql import functions as F

    from txnlens.operators.buckets import cut_points, place

    df = spark.createDataFrame([(None,), (-1.0,), (0.0,), (0.5,), (1.0,), (7.0,), (float("nan"),)], "x double")
    for cuts in ([], [0.0], [0.0, 0.5, 1.0], [0.0, 0.25, 0.5, 0.75, 1.0]):
        got = [r[0] for r in df.select(place(F.col("x"), cuts)).collect()]
        assert got == [0, *[sum(c <= x for c in cuts) for x in (-1.0, 0.0, 0.5, 1.0, 7.0)], len(cuts)]
    assert cut_points(df.limit(0), [F.col("x")], 8) == [[]]


def test_chi_square(spark):
    a = spark.createDataFrame([(x,) for x in ["p"] * 30 + ["q"] * 20 + [None] * 10], "k string")
    b = spark.createDataFrame([(x,) for x in ["p"] * 10 + ["q"] * 25 + ["new"] * 5], "k string")
    cells = [(30, 10), (20, 25), (10, 0), (0, 5)]
    expected = sum((n - (r + c) * side / 100) ** 2 / ((r + c) * side / 100) for r, c in cells for n, side in ((r, 60), (c, 40)))
    r = drift.chi_square(a, b, ["k"]).first()
    assert r["chi_square"] == pytest.approx(expected) and r["degrees"] == 3
    assert drift.chi_square(a, a, ["k"]).first()["chi_square"] == pytest.approx(0) and drift.chi_square(a, b.limit(0), ["k"]).first()["chi_square"] is None
    assert drift.chi_square(a.limit(0), b.limit(0), ["k"]).count() == 0


def test_imbalance_policies(spark):
    from txnlens.operators import ml

    df = scored(spark, [0, 0, 0, 1], [0.1] * 4)
    weights = lambda policy: {r["label"]: r["weight"] for r in ml.weighted(df, "label", policy).collect()}
    assert weights("scale_pos_weight") == {0: 1.0, 1: 3.0} and weights("class_weights") == {0: pytest.approx(2 / 3), 1: 2.0}
    with pytest.raises(ValueError):
        weights("other")
