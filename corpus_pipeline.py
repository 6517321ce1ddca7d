"""A training-data pipeline of five stages over the documents table; each stage works on what the one before kept.

Defined cases: a document with a null, empty or letterless text has no language and goes in the first stage; a text of any
length is judged whole. Line dedup keeps every document, one whose lines all repeat with an empty text. Repeated rows stay
until near dedup, which keeps the one with the smallest id, of equal ids the first read; ties of scores go to the first
language in order. Nulls in other columns pass through. An empty table gives no rows. Columns beside those of documents are
kept but for ``n_lines`` and ``n_removed``, which are not returned, and ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``,
which the last stage sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.llm import bpe, common, decontam, langid, linedup, minhash
from txnlens.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a known language, by the network trained on those that are not held out."""
    return langid.keep_known(docs, langid.train(docs.filter(~langid.held_out("doc_id"))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines that an earlier line resembles; ``n_chars`` follows the text."""
    out = linedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8)."""
    return minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token counts and digests of their ids and of the decoded bytes."""
    return bpe.tokenized(docs, *tokenizer())


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written and read again.

    A stage's own tables go when its result is written, the result when the next one is; what is left is the last table read.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with common.scratch() as keep:
            docs = common.materialize(stage(spark, docs, sf_dir))
            keep(docs)
        if before is not None:
            common.forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
