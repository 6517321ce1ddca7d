import random

import pytest
from pyspark.sql import functions as F

from txnlens.llm import linedup as ld

from .helpers import docs, lower, rows, words


def brute(texts, t=80):
    seen, out = [], []
    for text in texts:
        if text is None:
            out.append((None, 0, 0))
            continue
        kept, gone = [], 0
        for line in text.split("\n"):
            s = frozenset(words(lower(line)))
            if s and any(100 * len(s & o) >= t * len(s | o) for o in seen):
                gone += 1
            else:
                kept.append(line)
            if s:
                seen.append(s)
        out.append(("\n".join(kept), len(text.split("\n")), gone))
    return out


def make(seed):
    rng = random.Random(seed)
    v = [f"w{i}" for i in range(60)] + ["The", "the", "of", "É"]
    base = [rng.choices(v, k=rng.choice([1, 2, 3, 4, 5, 8, 12, 30])) for _ in range(25)]
    texts = [None, "", "\n\n", "a\n\n a \nA"]
    for _ in range(25):
        lines = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(base))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(v)
            lines.append("  ".join(line))
        texts.append("\n".join(lines))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    texts = make(seed)
    got = rows(ld.dedup_lines(docs(spark, texts)))
    assert [(got[i]["text"], got[i]["n_lines"], got[i]["n_removed"]) for i in range(len(texts))] == brute(texts)


def test_native_plan(spark):
    plan = ld.dedup_lines(docs(spark, make(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edges(spark):
    assert ld.dedup_lines(docs(spark, ["x"]).limit(0)).count() == 0
    df = docs(spark, ["a b c", "d e f"]).union(docs(spark, ["a b c"])).withColumn("n_lines", F.lit("x")).withColumn("doc", F.lit(9)).withColumn("gone", F.lit(True))
    out = ld.dedup_lines(df)
    assert set(out.columns) == set(df.columns) | {"n_removed"} and sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(0, ""), (0, "a b c"), (1, "d e f")]
    named = docs(spark, ["a b c", "a b c"]).withColumn("doc_id", F.when(F.col("doc_id") == 1, F.lit("k")))
    assert {(r["doc_id"], r["text"]) for r in ld.dedup_lines(named).collect()} == {("k", "a b c"), (None, "")}


def test_long_lines_many_lines_and_long_lists(spark, monkeypatch):
    rng = random.Random(9)
    v = [f"v{i}" for i in range(3000)]
    long = [rng.choices(v, k=2500) for _ in range(3)]
    near = [" ".join([*line[:-40], *rng.choices(v, k=40)]) for line in long]
    many = "\n".join(f"k{i % 700} a{i % 350} b c d e" for i in range(4000))
    texts = [" ".join(long[0]), "\n".join([*near, " ".join(long[1])]), many, many + "\nunlike all others here", None, ""]
    monkeypatch.setattr(ld, "SHORT_LIST", 8)
    monkeypatch.setattr(ld, "BROADCAST_ROWS", 0)  # both sides are shuffled
    got = rows(ld.dedup_lines(docs(spark, texts)))
    assert [(got[i]["text"], got[i]["n_lines"], got[i]["n_removed"]) for i in range(len(texts))] == brute(texts)


def test_the_table_of_counts_stands_in_no_plan(spark, monkeypatch):
    """The driver keeps a plan's text with every query; a table of 262,144 numbers in it is megabytes each time."""
    lengths = []

    def noted(df, write=ld.materialize):
        lengths.append(len(df._jdf.queryExecution().toString()))
        return write(df)

    monkeypatch.setattr(ld, "materialize", noted)
    docs = spark.createDataFrame([(1, "a b c d e f\nx"), (2, "a b c d e f\ny")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs).collect()} == {1: "a b c d e f\nx", 2: "y"}
    assert max(lengths) < 100_000


def test_words_are_counted_without_lines_and_sorted_as_plain_numbers(spark, monkeypatch):
    """A text is split into words once, not first into lines; an array that could hold nulls would be sorted as objects."""
    tables = []
    monkeypatch.setattr(ld, "materialize", lambda df, write=ld.materialize: tables.append(df) or write(df))
    assert ld.dedup_lines(docs(spark, make(3))).count() == 29
    (levels,) = [t for t in tables if t.columns == ["levels"]]
    assert levels._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    (lines,) = [t for t in tables if "keys" in t.columns]
    assert not lines.schema["keys"].dataType.containsNull


@pytest.mark.parametrize("threshold", [50, 100])
def test_pairs_are_intersected_once(spark, monkeypatch, threshold):
    """A filter computes twice what it names twice."""
    tables = []
    monkeypatch.setattr(ld, "materialize", lambda df, write=ld.materialize: tables.append(df) or write(df))
    got = rows(ld.dedup_lines(docs(spark, make(4)), threshold=threshold))
    assert [(got[i]["text"], got[i]["n_lines"], got[i]["n_removed"]) for i in range(29)] == brute(make(4), threshold)
    times = [t._jdf.queryExecution().optimizedPlan().toString().count("array_intersect(") for t in tables]
    assert [n for n in times if n] == [1, 1]


def test_words_of_texts_are_those_of_their_lines(spark):
    texts = ["a b\nc  \n\n d", "É x\nplain\ty", "tab\there\nthere", "\r\n\x0b", ""]
    df = docs(spark, texts).withColumn("line", F.explode(F.split("text", "\n")))
    some = lambda c, **k: {(r[0], r[1]) for r in df.select("doc_id", F.explode(ld.split_words(F.col(c), **k))).collect() if r[1]}
    assert some("text", lines=True) == some("line") and len(some("line")) == 11
