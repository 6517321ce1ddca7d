import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlens.llm import minhash as m
from txnlens.llm.components import components

from .helpers import docs, lower, rows, words


def sets(text, k):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(texts, k):
    s = [sets(t, k) for t in texts]
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s[i]), find(i)) for i in range(len(s))]


def corpus(seed, n=12, copies=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " ", "Only", "only", "two words", "TWO words", "one two three four", "one two three four five"]
    for _ in range(n):
        base = rng.choices(vocabulary, k=rng.choice([4, 8, 30, 120, 400]))
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 8)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,k", [(1, 2), (3, 5)])
def test_matches_brute_force(spark, seed, k):
    texts = corpus(seed)
    got = rows(m.near_duplicates(docs(spark, texts), words=k))
    for i, (n, c) in enumerate(brute(texts, k)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, i == c), texts[i]
    if k == 2:
        return
    kept = sorted(r["doc_id"] for r in m.drop_near_duplicates(docs(spark, texts), words=k).collect())
    assert kept == [i for i, (_, c) in enumerate(brute(texts, k)) if i == c]


def test_chain_and_cloud(spark):
    """A chain of neighbours is one component; so is a cloud whose members mostly meet through the original."""
    base = [f"b{i}" for i in range(100)]
    chain = [" ".join(base[i * 5 : ] + [f"x{j}" for j in range(i * 5)]) for i in range(8)]
    rng, cloud = random.Random(3), []
    hub = [f"c{i}" for i in range(200)]
    for _ in range(25):
        w = list(hub)
        for p in rng.sample(range(200), 9):
            w[p] = f"y{rng.random()}"
        cloud.append(" ".join(w))
    texts = [*chain, *cloud, " ".join(hub)]
    got = rows(m.near_duplicates(docs(spark, texts), words=2))
    assert [got[i]["component_id"] for i in range(len(texts))] == [c for _, c in brute(texts, 2)]


def test_blocks_of_a_list_meet_once(spark):
    lists = [("one", 1), ("some", 7), ("many", 60)]
    df = spark.createDataFrame([(k, u, n) for k, n in lists for u in range(n)], "key string, uid long, size long")
    x, y = m._block_against_block(df, 8)
    met = x.withColumnRenamed("uid", "a").join(y.withColumnRenamed("uid", "b"), ["key", "low", "high"]).filter("low < high or a < b")
    got = [(r["key"], *sorted((r["a"], r["b"]))) for r in met.collect()]
    assert sorted(got) == sorted((k, a, b) for k, n in lists for b in range(n) for a in range(b))
    assert x.groupBy("key", "low", "high").count().agg(F.max("count")).first()[0] < 20


def test_lists_in_blocks(spark, monkeypatch):
    """Many texts share words that none of the first or last of a list is near to, so that lists are joined with themselves."""
    monkeypatch.setattr(m, "BLOCK", 4)
    rng, texts = random.Random(8), []
    common = [f"c{i}" for i in range(60)]
    for _ in range(12):
        own = [f"o{rng.random()}" for _ in range(40)]
        texts += [" ".join([*common, *own]), " ".join([*common, *own[:-1], "end"]), " ".join([*common, *own[1:]])]
    rng.shuffle(texts)
    blocks, real = [], m._block_against_block
    monkeypatch.setattr(m, "_block_against_block", lambda members, block: blocks.append(members.agg(F.max("size")).first()[0]) or real(members, block))
    got = rows(m.near_duplicates(docs(spark, texts), words=2))
    assert [got[i]["component_id"] for i in range(len(texts))] == [c for _, c in brute(texts, 2)]
    assert blocks and blocks[0] > 4


def test_long_texts(spark):
    """Texts of a million characters and a word of as many are judged whole: two that differ at the end only are linked, two alike at the beginning only are not."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(50_000)}" for _ in range(150_000)]
    texts = [" ".join(base), " ".join([*base[:-1000], "other", "end"]), " ".join([*base[:75_000], *reversed(base[:75_000])]), "z" * 1_000_000, "Z" * 1_000_000 + " "]
    got = rows(m.near_duplicates(docs(spark, texts)))
    assert [got[i]["component_id"] for i in range(5)] == [0, 0, 2, 3, 3] == [c for _, c in brute(texts, 5)]
    assert [got[i]["n_shingles"] for i in range(5)] == [n for n, _ in brute(texts, 5)]


def test_prefix_rules():
    n = np.array([1, 2, 3, 4, 5, 10, 51, 52, 64, 5000])
    assert m.prefix_length(n, 80).tolist() == [1, 1, 1, 1, 2, 3, 11, 21, 33, 33] and m.share_at_least(80) == 32


def test_edges(spark):
    assert m.near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0
    df = docs(spark, ["a b c d e f"] * 2).union(docs(spark, ["a b c d e f"])).withColumn("n", F.lit(1)).withColumn("row", F.lit("r")).withColumn("uid", F.lit(7))
    assert [r["component_id"] for r in m.near_duplicates(df).collect()] == [0, 0, 0]
    out = m.drop_near_duplicates(df)
    assert out.columns == df.columns and [r["doc_id"] for r in out.collect()] == [0]
    null = docs(spark, ["a b c d e f", "other words are in this one"]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert sorted((r["doc_id"] is None, r["kept"]) for r in m.near_duplicates(null).collect()) == [(False, True), (True, True)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5001 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
