import numpy as np
from pyspark.sql import functions as F

from txnlens.operators import boosting


def brute(x, y, cuts, trees, depth, rate, l2, weight, min_child):
    """Trees by trying every cut of every node's rows."""
    margin, w = np.zeros(len(y)), np.where(y == 1, weight, 1.0)

    def grow(rows, level, g, h):
        if level < depth:
            best = (1e-9, None)
            for j, edges in enumerate(cuts):
                for e in edges:
                    left = rows & ~(x[:, j] >= e)  # nulls go left
                    right = rows & ~left
                    if h[left].sum() >= min_child and h[right].sum() >= min_child:
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (left, right))
            if best[1]:
                return sum(grow(s, level + 1, g, h) for s in best[1])
        return np.where(rows, -rate * g[rows].sum() / (h[rows].sum() + l2), 0.0)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + grow(np.ones(len(y), bool), 0, w * (p - y), w * p * (1 - p))
    return 1 / (1 + np.exp(-margin))


def test_equals_a_brute_force_trainer(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 3)), 1)
    y = (x[:, 0] * x[:, 1] + rng.normal(size=300) / 3 > 0.2).astype(float)
    x[rng.random(300) < 0.05, 2] = np.nan
    rows = [(i, *[None if v != v else float(v) for v in r], int(t), "x") for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (900, 1.0, 1.0, 1.0, None, "no label")], "id long, a double, p double, c double, y int, row string").repartition(4)
    model = boosting.fit(df, ["a", "p", "c"], "y", trees=13, depth=3, rate=0.3, l2=1.5, positive_weight=2.0, bins=8, min_child=0.5)
    want = brute(x, y, model.cuts, 13, 3, 0.3, 1.5, 2.0, 0.5)
    out = model.score(df)
    assert out.columns == [*df.columns, "risk_score"] and out.count() == 301
    got = {r["id"]: r["risk_score"] for r in out.collect()}
    assert np.allclose([got[i] for i in range(300)], want, atol=1e-9)


def test_one_class_and_nothing(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "a double, y int")
    model = boosting.fit(df, ["a"], "y", trees=2, depth=2)
    assert all(r["risk_score"] > 0.5 for r in model.score(df).collect())
    empty = boosting.fit(df.limit(0), ["a"], "y", trees=1, depth=1)
    assert [r["risk_score"] for r in empty.score(df.withColumn("a", F.lit(None).cast("double"))).collect()] == [0.5, 0.5]


def test_many_blocks_few_passes_and_only_features_go_to_python(spark):
    """A tree takes a pass a level and one for the margin; a column that Arrow can't hold stays as it is."""
    rows = spark.range(0, 40_000, 1, 2).selectExpr("double(id % 97) a", "double(id % 13) b", "int(id % 97 > 40 and id % 13 < 9) y")
    sc = spark.sparkContext

    def passes(trees):
        sc.setJobGroup(f"boost-{trees}", "")
        try:
            model = boosting.fit(rows, ["a", "b"], "y", trees=trees, depth=3)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        status = sc.statusTracker()
        return len({s for j in status.getJobIdsForGroup(f"boost-{trees}") for s in status.getJobInfo(j).stageIds if status.getStageInfo(s).numCompletedTasks == 2}), model

    few, _ = passes(2)
    many, model = passes(12)
    assert many - few <= 10 * (3 + 1)
    scored = model.score(rows.selectExpr("*", "make_interval(0, 1, 2) AS held")).select("y", "risk_score", "held")
    assert scored.filter("(risk_score > 0.5) != (y = 1)").count() == 0 and scored.filter("extract(MONTH FROM held) = 1").count() == 40_000
