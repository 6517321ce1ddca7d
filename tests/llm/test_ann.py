import os

import numpy as np
from pyspark.sql import functions as F

from txnlens.llm import ann, common

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], SCHEMA)


def tuples(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in df.collect())


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(1)
    near = rng.normal(size=(40, 16))
    x = np.concatenate([rng.normal(size=(900, 16)), np.repeat(near, 15, 0) + rng.normal(size=(600, 16)) / 50])
    df = table(spark, enumerate(x.tolist())).withColumns({"shard": F.lit("s"), "v": F.lit(1), "rank": F.lit(2), "id": F.lit("i")}).repartition(3)
    found, exact = ann.nearest(df, every=10, shard_points=400), ann.brute_force(df, every=10)
    assert found.count() == exact.count() == 1500 and ann.recall(found, exact) >= 0.99
    want = {(r["query_id"], r["vec_id"]): r["score"] for r in exact.collect()}
    assert all(want.get(r[0:3:2], r[3]) == r[3] for r in tuples(found))


def test_copies_ties_and_few_candidates(spark):
    """A vector that most rows share is one point; its members come by their ids, without the query's own row."""
    rows = [(i, [1.0, 2.0]) for i in range(0, 400)] + [(1000 + i, [1.0, 2.0 + i]) for i in range(1, 6)] + [(5, [1.0, 2.0])] * 3
    df = table(spark, rows)
    assert tuples(ann.nearest(df)) == tuples(ann.brute_force(df))
    got = [r for r in tuples(ann.nearest(df)) if r[0] == 100]
    assert [r[2] for r in got] == list(range(10)) and got[0] == (100, 1, 0, 0.0)
    assert tuples(ann.nearest(table(spark, [(0, [1, 1]), (1, [2, 1]), (2, [0, 1])]))) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, None), (2, []), (3, [0, 0]), (4, [None, 1]), (5, [nan, 1]), (6, [inf, 1]), (None, [1, 0]), (7, [1, 0, 0]), (8, [2, 0]), (100, [0, 0]), (200, [1, 1, 1]), (8, [5, 0])]
    assert tuples(ann.nearest(table(spark, rows))) == [(0, 1, 8, 1.0), (200, 1, 7, 2**0.5)]
    folder = common.shared_folder(spark)
    before = set(os.listdir(folder))
    assert ann.nearest(table(spark, [])).count() == 0 and ann.nearest(table(spark, [(1, [1])])).count() == 0
    assert len(set(os.listdir(folder)) - before) == 2  # the results


def test_pruning_keeps_diverse_edges():
    x = np.array([[0.0, 0], [1, 0], [1.1, 0], [0, 2], [0, 2.1], [-3, 0]])
    kept = ann.Graph(x, np.full((6, 48), -1)).prune(np.array([0]), np.array([[1, 2, 3, 4, 5, 0, 1, -1]]), 1.0, 4)
    assert kept.tolist() == [[1, 3, 5, -1]]


def test_the_graph_is_walked_and_bounded():
    x = np.random.default_rng(2).normal(size=(700, 8))
    g = ann.build(x)
    assert g.edges.shape == (700, ann.SLACK) and (np.sort(g.edges, 1)[:, 1:][np.sort(g.edges, 1)[:, 1:] >= 0] >= 0).all()
    assert not (g.edges == np.arange(700)[:, None]).any()
    ids, dist = g.search(x[:50], 64)
    assert (ids[:, 0] == np.arange(50)).all() and (np.diff(dist, axis=1) >= 0).all() and all(len(set(r)) == 64 for r in ids.tolist())
