"""Byte-level BPE encoding and decoding by merge replay over the distinct words of a batch.

The texts of a batch are cut into words by the tokenizer's pattern; each distinct word that no earlier batch of the
worker has seen enters one replay: an inverted index from the rank of a mergeable pair to the positions where the pair
stands applies merges in rank order over all those words together, and after a merge only the two touched neighbours are
looked at again. A worker keeps encoded words in two generations of ``STORE_WORDS``: when the younger is full it becomes the
older, whose words come back as they are met, so that common words are replayed once and memory is bounded by twice that and
by one batch. One index over the whole corpus would have to send every text its words' ids: a broadcast that grows with the
vocabulary, or a shuffle of every text and its distinct words.

Defined cases: a null text is empty; an empty text has no ids (the digest of an empty string). Bytes that form no
vocabulary entry cannot occur, as every single byte has an id. Repeated rows are encoded alike. Extra columns are
ignored by ``encode`` and ``digests`` and kept by ``tokenized``, where equally named ones are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, kept, parts

#: Encoded words that a generation of a worker's store holds at most, besides one batch's.
STORE_WORDS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def mergeable(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of each pair of tokens ``a << 20 | b`` that merge: every way to cut a token into two others."""
    out = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                out[a << 20 | b] = rank
    return out


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.token = ranks, {v: k for k, v in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pairs = mergeable(ranks)
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.bytes_of = {str(v): k for k, v in ranks.items()}
        #: word to its ids as decimals joined by commas
        self.store: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word: all merges of all words, lowest rank first, leftmost first within a rank."""
        tok: list[int] = []
        nxt: list[int] = []
        prv: list[int] = []
        starts = []
        byte, rank = self.byte, self.pairs.get
        for w in words:
            at, n = len(tok), len(w)
            starts.append(at)
            tok.extend([byte[b] for b in w])
            nxt.extend(range(at + 1, at + n + 1))
            prv.extend(range(at - 1, at + n - 1))
            nxt[-1], prv[at] = -1, -1
        index: dict[int, list[int]] = {}
        for p, q in enumerate(nxt):
            if q >= 0 and (r := rank(tok[p] << 20 | tok[q])) is not None:
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
        todo = list(index)
        heapify(todo)
        while todo:
            r = todo[0]
            at = index[r]
            at.sort()  # a merge makes no pair of its own rank, so nothing joins the list meanwhile
            for done, p in enumerate(at, 1):
                q = nxt[p]
                if q < 0 or (a := tok[p]) < 0 or rank(a << 20 | tok[q]) != r:
                    continue  # one of the two has been merged since
                tok[p], tok[q] = r, -1
                nxt[p] = after = nxt[q]
                low = r
                if after >= 0:
                    prv[after] = p
                    if (new := rank(r << 20 | tok[after])) is not None:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heappush(todo, new)
                        low = min(low, new)
                if (before := prv[p]) >= 0 and (new := rank(tok[before] << 20 | r)) is not None:
                    if new in index:
                        index[new].append(before)
                    else:
                        index[new] = [before]
                        heappush(todo, new)
                    low = min(low, new)
                if low < r:
                    index[r] = at[done:]
                    break  # a lower rank came up and goes first
            else:
                del index[r]
                heappop(todo)
        out = []
        for s in starts:
            ids, p = [], s
            while p >= 0:
                ids.append(tok[p])
                p = nxt[p]
            out.append(ids)
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """Have every word of the split texts in the store."""
        if len(self.store) > STORE_WORDS:
            self.store, self.older = {}, self.store
        store, older, ranks = self.store, self.older, self.ranks
        new = []
        for w in set().union(*texts):
            if w not in store:
                if w in older:
                    store[w] = older[w]
                else:
                    new.append(w)
        raw = [w.encode() for w in new]
        whole = [ranks.get(b) for b in raw]
        rest = iter(self.replay([b for b, r in zip(raw, whole, strict=True) if r is None]))
        for w, r in zip(new, whole, strict=True):
            store[w] = ",".join(map(str, next(rest))) if r is None else str(r)

    def ids(self, texts: list[str]) -> list[str]:
        """Each text's ids as decimals joined by commas."""
        words = [self.split(t) for t in texts]
        self.learn(words)
        return [",".join(map(self.store.__getitem__, ws)) for ws in words]

    def encode(self, text: str) -> list[int]:
        joined = self.ids([text])[0]
        return [int(i) for i in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])


def _bpe(path: str, pattern: str) -> Bpe:
    return kept((path, pattern), lambda: Bpe(read_ranks(path), pattern))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""

    def run(batch: pa.RecordBatch):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        joined = _bpe(path, pattern).ids(texts)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[int(i) for i in j.split(",")] if j else [] for j in joined], pa.list_(pa.int32()))], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, ids array<int>", max_bytes=1 << 20, keeps=True).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, raw binary): the bytes that each row's ids stand for; null ids give no bytes."""

    def run(batches):
        bpe = _bpe(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "raw"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, raw binary").withColumnRenamed("id", id_col)


def _digest(bpe: Bpe, texts: list[str]) -> list[tuple[int, str, str]]:
    out = []
    for joined in bpe.ids(texts):
        ids = joined.split(",") if joined else []
        decoded = b"".join(map(bpe.bytes_of.__getitem__, ids))
        out.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    return out


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): every text encoded, its ids decoded, both digested where they arise."""

    def run(batch: pa.RecordBatch):
        rows = _digest(_bpe(path, pattern), [t or "" for t in batch.column(1).to_pylist()])
        n, ids, decoded = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(src, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", max_bytes=1 << 20, keeps=True).withColumnRenamed("id", id_col)


def tokenized(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` with ``n_tokens`` and the two digests after them."""
    own = ["n_tokens", "ids_sha256", "decoded_sha256"]
    keep = [c for c in df.columns if c not in own]
    at = keep.index(text_col)

    def run(batches):
        for batch in parts(batches, at, 1 << 20, keeps=True):
            rows = _digest(_bpe(path, pattern), [t or "" for t in batch.column(at).to_pylist()])
            n, ids, decoded = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[*keep, *own])

    fields = [df.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, T.StructType(fields))
