import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from txnlens.llm import quality as q

from .helpers import docs, rows, words


def base(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \t\n", "one", "a b c a b c", "a b c d a b c", "x\x1cy z w", "l1 é\nl1 é\n\n\nl1 é ", "##**|<>&%$ a\x0bb", "ß 漢字 😀 ok\n" * 40, "w " * 200, " ".join(f"w{i}" for i in range(3000)), "same line here\r\nsame line here\n"]


def test_base_counts_match_brute_force(spark):
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choice("abcd") + rng.choice(["", "\n"]) for _ in range(rng.randrange(120))) for _ in range(40)]
    got = rows(q.judge_quality(docs(spark, texts), spark.createDataFrame([(11,)], "doc_id long")))
    for i, t in enumerate(texts):
        want = base(t)
        g = got[i]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        assert g["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert g["kept"] == (not g["base_failed"] and g["score"] >= q.THRESHOLD)


def test_repeats_with_a_large_vocabulary():
    ids = np.array([1 << 22, 5, 7, 9, 1 << 22, 5, 7, 3])
    assert q.repeated_words(ids) == 6


def test_score_is_the_mean_log_ratio(spark):
    texts = ["good plain words here " * 20, "junk $$ junk %% junk && " * 20, "good plain other words " * 20]
    df, trusted = docs(spark, texts), spark.createDataFrame([(0,), (None,)], "doc_id long")
    corpus, target = q.corpus_counts(df, trusted)
    grams = sum(2 * len(words(t)) - 1 for t in texts)
    assert corpus.sum() == grams and target.sum() == 2 * len(words(texts[0])) - 1
    ratio = q.log_ratio(corpus, target)
    import xxhash

    h = np.array([xxhash.xxh64_intdigest(w.encode()) for w in words(texts[1])], np.uint64)
    got = rows(q.judge_quality(df, trusted))
    assert math.isclose(got[1]["score"], ratio[q.buckets(h)].mean(), rel_tol=1e-12) and got[0]["score"] > got[2]["score"] > got[1]["score"]


def test_all_trusted_documents_count(spark):
    n = 21_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    _, target = q.corpus_counts(df, df.select("doc_id").union(df.select("doc_id")))
    assert target.sum() == n


def test_edges(spark):
    empty = docs(spark, ["x"]).limit(0)
    none = spark.createDataFrame([], "doc_id long")
    assert q.judge_quality(empty, none).count() == 0
    df = docs(spark, ["a b " * 60]).union(docs(spark, ["a b " * 60])).withColumn("score", F.lit("mine")).withColumn("n_words", F.lit(None).cast("string"))
    got = q.judge_quality(df, none).collect()
    assert len(got) == 2 and all(r["score"] == 0.0 and r["n_words"] == 120 for r in got)
