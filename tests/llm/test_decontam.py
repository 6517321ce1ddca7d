import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from txnlens.llm import decontam as d
from txnlens.llm.common import suffix_array

from .helpers import docs, lower, rows


def ws(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute(text, items):
    w, hit, found = ws(text), set(), set()
    for item, t in items:
        b = ws(t)
        n = min(13, len(b))
        for k in range(max(1, len(b) - 12) if b else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == b[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    names = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def make(seed):
    rng = random.Random(seed)
    v = ["a", "B", "c1", "é", "dd", "漢"]
    items = [(i, " ".join(rng.choices(v, k=rng.choice([1, 3, 12, 13, 14, 40])))) for i in range(25)] + [(30, None), (31, "..."), (7, "A b!"), (None, "q q q")]
    texts = [None, "", "?!", "A-b", "q q q Q", "a b"] + [" ".join(rng.choices(v + ["zz"], k=rng.randrange(60))) for _ in range(30)]
    texts += ["zz " + rng.choice(items[:25])[1].upper() + ", yy " * rng.randrange(200) for _ in range(30)]
    return items, texts


def test_matches_brute_force_in_one_block_and_many(spark):
    items, texts = make(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for words in (d.BLOCK_WORDS, 30):
        got = rows(d.judged(d.find_spans(docs(spark, texts), bench, block_words=words)))
        for i, t in enumerate(texts):
            n, hit, _, _, bad = brute(t, items)
            named = brute(t, [x for x in items if x[0] is not None])
            g = got[i]
            assert (g["n_words"], g["n_hit"], g["contaminated"]) == (n, hit, bad) and (g["n_items"], g["items_sha256"]) == named[2:4]
        kept = {r["doc_id"] for r in d.decontaminate(docs(spark, texts), bench, block_words=words).collect()}
        assert kept == {i for i, t in enumerate(texts) if not brute(t, items)[4]}


def test_shards_overlap(monkeypatch):
    items, texts = make(2)
    whole = d.Benchmark([(str(i), t) for i, t in items]).hits(texts)
    monkeypatch.setattr(d, "SHARD_WORDS", 40)
    assert d.Benchmark([(str(i), t) for i, t in items]).hits(texts) == whole


def test_index_counts_and_locates():
    rng = np.random.default_rng(0)
    seq = np.append(rng.integers(0, 5, 3000), 0)
    sa, _ = suffix_array(seq, 5)
    order = [(tuple((int(s), 0) if s else (0, p) for p, s in enumerate(seq[i : i + 40], i))) for i in sa[:400]]
    assert sorted(sa.tolist()) == list(range(len(seq))) and order == sorted(order)
    index = d.FMIndex(seq, 5)
    patterns = rng.integers(1, 5, (200, 3))
    which, lo, hi = index.search(patterns)
    text = seq.tolist()
    for k, p in enumerate(patterns.tolist()):
        want = [i for i in range(len(text) - 2) if text[i : i + 3] == p]
        at = np.flatnonzero(which == k)
        got = sorted(index.locate(np.arange(lo[at[0]], hi[at[0]])).tolist()) if len(at) else []
        assert got == want


def test_edges(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    df = docs(spark, ["a b"]).withColumn("n_words", F.lit("x")).withColumn("row", F.lit(1))
    assert rows(d.find_spans(df, bench))[0]["n_words"] == 2
    assert d.decontaminate(df, bench).columns == df.columns
    assert d.find_spans(df.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    one = docs(spark, ["x a b y"]).union(docs(spark, ["x a b y"]))
    assert [r["starts"] for r in d.find_spans(one, spark.createDataFrame([(1, "a b"), (1, "a b")], "item_id long, text string")).collect()] == [[1], [1]]
