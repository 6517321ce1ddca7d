import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from txnlens.llm import bpe

from .helpers import docs, rows

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [None, "", " ", "\n\n  \t x", "Hello world, it's 2024!", "ß 漢字 😀\x1c\x85\xa0 ok", "aaaa" * 3000, "<|endoftext|> x", "क्षि 'S 'll ''", "\x00\x01\ufffd"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_replay_equals_the_library(reference):
    own, rng = bpe.Bpe(bpe.read_ranks(PATH), PATTERN), random.Random(2)
    alphabet = list("ab e t h s 1 2 ' \t\n_!é漢क") + ["'s", "  ", "tion", "\x1c", "\xa0", "😀"]
    for text in [t or "" for t in TEXTS] + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(3000)]:
        ids = own.encode(text)
        assert ids == reference.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_lower_ranks_that_merges_create_go_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 257, b"abc": 256, b"xy": 258}
    assert bpe.Bpe(ranks, r"\S+").replay([b"abcbcabc", b"xyx"]) == [[256, 257, 256], [258, 120]]


def test_generations_of_the_store(reference, monkeypatch):
    monkeypatch.setattr(bpe, "STORE_WORDS", 20)
    own, rng = bpe.Bpe(bpe.read_ranks(PATH), PATTERN), random.Random(5)
    for _ in range(60):
        texts = [" ".join(f"w{min(rng.randrange(9), rng.randrange(500))}x" for _ in range(rng.randrange(30))) for _ in range(3)]
        assert own.ids(texts) == [",".join(map(str, reference.encode_ordinary(t))) for t in texts]
        assert len(own.store) + len(own.older) <= 2 * (20 + 2 * 90)


def test_digests_and_round_trip(spark, reference):
    got = rows(bpe.digests(docs(spark, TEXTS), PATH, PATTERN))
    for i, t in enumerate(TEXTS):
        ids = reference.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = rows(bpe.decode(bpe.encode(docs(spark, TEXTS), PATH, PATTERN), PATH, PATTERN))
    assert [bytes(back[i]["raw"]).decode() for i in range(len(TEXTS))] == [t or "" for t in TEXTS]


def test_store_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "STORE_WORDS", 5)
    own = bpe.Bpe(bpe.read_ranks(PATH), PATTERN)
    for i in range(20):
        own.ids([f"alpha{i} beta{i}"])
    assert len(own.store) <= 5 + 6


def test_edges(spark):
    df = docs(spark, ["x"]).withColumn("n_tokens", F.lit("mine"))
    out = bpe.tokenized(df, PATH, PATTERN)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256"] and out.first()["n_tokens"] == 1
    assert bpe.digests(df.limit(0), PATH, PATTERN).count() == 0
