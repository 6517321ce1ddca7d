import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from txnlens.llm import phrases as p

from .helpers import lower


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", x) for x in re.split(r"[.,;:!?\x0A-\x0D]", lower(text))]


def brute(rows, min_count, top=2000):
    out, f, n = [], {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    f[key] = f.get(key, 0) + 1
    for lang in n:
        cand = {g: a for (x, g), a in f.items() if x == lang and len(g) > 1 and a >= min_count}
        scored = []
        for g, a in cand.items():
            score, _, le, ri = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            longer = [b for h, b in cand.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if not any(100 * b >= 80 * a for b in longer):
                scored.append((-score, -a, " ".join(g).encode(), le, ri))
        out += [(lang, i, g.decode(), -a, le, ri, n[lang], -s) for i, (s, a, g, le, ri) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["Red", "blue", "ünder", "É", "x" * 40, "a'b", "-", "NEW york", "of\tthe ", "one\x00two"]
    ends = [".", ", ", "\n", " ", "\r\n", "?!", "\x0b", " \t"]
    return [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", *ends]) for _ in range(rng.randrange(80)))) for _ in range(n)] + [(None, None), ("en", ""), ("xx", "  . ")]


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def tuples(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("seed,size,bits", [(1, 1 << 20, None), (2, 64, 16), (3, 7, 4)])
def test_matches_brute_force(spark, seed, size, bits):
    """Also with texts cut into short segments, and with a sketch so small that nearly everything survives it."""
    rows = corpus(seed)
    df = table(spark, rows).repartition(3).withColumns({"n": F.lit(1), "phrase": F.lit("x"), "words": F.lit(2)})
    assert tuples(p.collocations(df, min_count=4, bits=bits, size=size)) == brute(rows, 4)
    assert tuples(p.collocations(df, min_count=4, top=3, bits=bits, size=size)) == brute(rows, 4, 3)


def test_subsumption_and_ties(spark):
    rows = [("en", "alpha beta gamma delta")] * 8 + [("en", "alpha beta")] * 2 + [("en", "gamma delta")] * 3 + [("en", "q r. s t")] * 5
    got = tuples(p.collocations(table(spark, rows), min_count=5))
    assert got == brute(rows, 5) and [r[2] for r in got] == ["gamma delta", "q r", "s t", "alpha beta gamma delta"]  # of alpha beta 80 percent are inside


def test_segments_own_every_gram_once():
    rng = np.random.default_rng(5)
    text = bytes(rng.choice(list(b"ab .\n\t"), 4000, p=[0.4, 0.3, 0.2, 0.03, 0.02, 0.05]).tolist()).decode()
    for size in (1, 5, 64, 1000, 10_000):
        got = Counter()
        for data, first, rows, owned in p.segments(pa.record_batch([pa.array([text])], names=["t"]), 4, size):
            words = p.Words(data, first, np.zeros(len(rows), np.int64))
            for n, at, _ in words.grams(np.zeros(1, np.uint64), 4, owned):
                got.update((n, x) for x in words.phrases(at, n).to_pylist())
        want = Counter((k, " ".join(w[i : i + k]).encode()) for w in pieces(text) for k in range(1, 5) for i in range(len(w) - k + 1))
        assert got == want, size


def test_edges(spark):
    assert p.collocations(table(spark, []), min_count=1).count() == 0
    assert p.collocations(table(spark, [(None, None), ("en", "")]), min_count=1).count() == 0
    long = "word " * 200_000 + "x" * 300_000 + " y z"
    got = tuples(p.collocations(table(spark, [("en", long)]), min_count=2, size=1 << 16))
    assert got == [("en", 1, "word word word word", 199_997, 200_000, 199_998, 200_003, 2000000 * 199_997 // 399_998)]


def test_products_beyond_64_bits(spark):
    big = 1 << 62
    found = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big), ("en", "b", 1, big + 1)], "lang string, phrase string, words int, f long")
    assert [(r["score"], r["l"]) for r in p.scored(found).collect()] == [(2000000 * big // (2 * big + 1), big)]
    longer = spark.createDataFrame([("en", "a b", 2, big), ("en", "a b c", 3, big * 8 // 10 + 1), ("en", "b c", 2, big + 9)], "lang string, phrase string, words int, a long")
    assert sorted(r["phrase"] for r in p.subsumed(longer).collect()) == ["a b c", "b c"]
