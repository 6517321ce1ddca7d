import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlens.llm import langid as g

from .helpers import DOCS

SYLLABLES = {"aa": ["ba", "na", "ka", "ta "], "bb": ["èz", "üx ", "ñi", "ço"], "cc": ["th", "ing ", "er", "on "]}


def corpus(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, "".join(rng.choices(SYLLABLES[lang], k=rng.choice([20, 60, 400]))), lang, "s", 0))
    return out


def test_gradients():
    m, rng = g.BiGru.new(["a", "b"], 3, 1), np.random.default_rng(0)
    x, y = rng.integers(1, 255, (5, g.STEPS)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    _, grads = m.step(x, y)
    for p, gr in zip((m.table, m.u, m.v, m.c), grads):
        at = np.unravel_index(np.abs(gr).argmax(), gr.shape)
        old, losses = p[at], []
        for e in (1e-2, -1e-2):
            p[at] = old + e
            losses.append(m.step(x, y)[0])
        p[at] = old
        assert gr[at] == pytest.approx((losses[0] - losses[1]) / 2e-2, rel=2e-2)


def test_held_out_accuracy_and_unknown(spark):
    data = corpus(240) + [(1000, None, "aa", "s", 0), (1001, "", "aa", "s", 0), (1002, "123 !? 😀", "bb", "s", 0), (1003, "x", None, "s", 0)]
    df = spark.createDataFrame(data, DOCS)
    model = g.train(df.filter(~g.held_out("doc_id")), updates=60)
    got = {r["doc_id"]: r for r in g.predict(df.withColumn("score", F.lit("clash")), model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in held) for i in range(240))
    assert np.mean([got[i]["lang_pred"] == data[i][2] for i in held]) > 0.95
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and got[1003]["lang_pred"] in SYLLABLES
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = g.keep_known(df, model)
    assert kept.columns == df.columns and {1000, 1001, 1002}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_long_texts(spark):
    """The language of most of a long text counts, not that of its beginning; a text without an end of words is judged too."""
    df = spark.createDataFrame(corpus(240), DOCS)
    model = g.train(df.filter(~g.held_out("doc_id")), updates=60)
    rng = random.Random(5)
    of = lambda lang, n: "".join(rng.choices(SYLLABLES[lang], k=n))
    texts = [of("aa", 2_000) + of("cc", 200_000), of("bb", 100_000).replace(" ", ""), of("cc", 500)]
    got = {r["doc_id"]: r for r in g.predict(spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], DOCS), model).collect()}
    assert [got[i]["lang_pred"] for i in range(3)] == ["cc", "bb", "cc"] and all(0 <= r["score"] <= 1 for r in got.values())


def test_every_byte_is_labelled_and_pooling_is_their_mean():
    m = g.BiGru.new(["a", "b", "c"], 4, 2)
    text = ("täxt " * 50).encode()
    x, many = g.windows([text])
    p = m.probabilities(m.states(np.ascontiguousarray(x.T))).transpose(2, 0, 1).reshape(-1, 3)[: len(text)]
    assert many.tolist() == [5] and len(m.positions(text)) == len(text)
    assert np.allclose(m.pooled([text, b"", text])[[0, 2]], p.mean(0), atol=1e-5) and m.pooled([b""]).tolist() == [[0, 0, 0]]


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None, "s", 0)], DOCS)
    assert g.train(df) is None and g.predict(df, None).first()["lang_pred"] == "und"
    assert g.predict(df.limit(0), None).count() == 0


def test_rare_languages_are_in_the_sample(spark):
    rows = spark.range(30_000).select(F.concat(F.lit("t"), "id").alias("t"), F.when(F.col("id") % 3000 == 7, "xx").when(F.col("id") == 1, "yy").otherwise("en").alias("l"))
    found = {r["l"]: r["count"] for r in g._sample(rows, 1000).groupBy("l").count().collect()}
    assert found["xx"] == 10 and found["yy"] == 1 and 850 < found["en"] < 1150
    assert g._sample(rows, 40_000).count() == 30_000 and g._sample(rows.limit(0), 5).count() == 0
