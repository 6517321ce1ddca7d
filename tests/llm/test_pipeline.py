"""The pipeline's stages on a small table, against plain versions of what they decide."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from txnlens.llm.queries import QUERIES

from .helpers import DOCS

LETTERS = {"aa": ["ba", "na", "ka", "ta", "sa"], "bb": ["zü", "xü", "ñi", "ço", "qü"]}


def text(lang, seed, words=40, lines=4):
    import random

    rng = random.Random(f"{lang}{seed}")
    return "\n".join(" ".join("".join(rng.choices(LETTERS[lang], k=3)) for _ in range(words)) for _ in range(lines))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    docs = [(i, text("aa" if i % 2 else "bb", i), "aa" if i % 2 else "bb", "s", 0) for i in range(60)]
    passage = text("aa", "bench", 30, 1)
    docs += [(100, docs[0][1], "bb", "s", 0), (101, None, None, None, None), (102, "12345", "aa", "s", 0), (103, passage + "\n" + text("aa", 103), "aa", "s", 0), (104, docs[1][1].split("\n")[0] + "\nnew words ba na", "aa", "s", 0)]
    spark.createDataFrame(docs, DOCS).coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_in_order_and_effect(spark, folder):
    assert [n for n, _ in cp.STAGES] == ["language", "line_dedup", "near_dedup", "decontaminate", "encode"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, folder).persist()
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "encode":
            assert docs.columns == columns
    assert set(seen["language"]) == set(range(60)) | {100, 103, 104}
    lines = seen["line_dedup"]
    assert lines[100]["text"] == "" and lines[104]["text"] == "new words ba na" and lines[5]["text"] == seen["language"][5]["text"] and lines[104]["n_chars"] == 15
    assert set(seen["near_dedup"]) == set(lines) and set(seen["decontaminate"]) == set(lines) - {103}
    last = seen["encode"]
    assert all(r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in last.values())
    assert {r["doc_id"]: r["n_tokens"] for r in cp.run(spark, folder).collect()} == {k: r["n_tokens"] for k, r in last.items()}


def test_near_dedup_keeps_one_of_each_group(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id in (0, 1, 100)")
    near = docs.filter("doc_id = 1").withColumn("doc_id", F.lit(200).cast("long")).withColumn("text", F.concat("text", F.lit(" more")))
    kept = cp.near_dedup(spark, docs.union(near), folder)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1]


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_its_tables_go(spark, folder):
    from pathlib import Path

    from txnlens.llm import common

    at = Path(common.shared_folder(spark))
    before = len(list(at.iterdir()))
    with common.scratch():
        n = cp.run(spark, folder).count()
        assert n == 62 and len(list(at.iterdir())) == before + 1  # the last stage's input
    assert len(list(at.iterdir())) == before


def test_other_columns_stay(spark, folder, tmp_path):
    more = {"id": F.lit(1), "row": F.lit("r"), "n_lines": F.lit("x"), "score": F.lit(2.5), "n_tokens": F.lit("y")}
    spark.read.parquet(f"{folder}/documents.parquet").withColumns(more).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["ids_sha256"] for r in got} == {r["doc_id"]: r["ids_sha256"] for r in cp.run(spark, folder).collect()}
    assert {(r["id"], r["row"], r["score"]) for r in got} == {(1, "r", 2.5)} and all(isinstance(r["n_tokens"], int) for r in got)


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
