"""Quality rules: base counts of a text, and the log-likelihood ratio of hashed n-grams between trusted texts and the corpus.

Every text's words and word pairs are hashed into a fixed number of buckets. One scan sums the buckets over the whole
corpus and over all trusted documents, which a join with the trusted ids marks; the sums, two numbers a bucket, are all
that reaches the driver. A second scan scores each document by the mean over its n-grams of log(trusted share / corpus
share) and compares that with a fixed threshold. The bucket sums are summed within each task before they are shuffled.

Defined cases: a null text has no words; a document without words scores 0 and fails the base rule. Rows with a trusted
id count as trusted each time they occur. Without a trusted document all scores are 0. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, parts

#: Hash buckets of the two multinomials.
BUCKETS = 1 << 14
#: Trusted ids that are broadcast at most (about 24 MB).
BROADCAST_IDS = 1_000_000
#: Mean log ratio under which a document goes, in nats per n-gram.
THRESHOLD = -0.2
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - 14)


class Words(dict):
    """Word to a dense number, with the words' hashes beside; emptied between batches once it is large."""

    def __init__(self):
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n

    def trim(self) -> None:
        if len(self) > 100_000:
            self.clear()
            self.hashes.clear()


def buckets(h: np.ndarray) -> np.ndarray:
    """Buckets of the words and of the pairs of adjacent words, from the words' hashes in text order."""
    pairs = (h[:-1] * _MUL2 + (h[1:] ^ (h[1:] >> np.uint64(31)))) * _MUL
    return np.concatenate([(h * _MUL) >> _SHIFT, pairs >> _SHIFT]).astype(np.int64)


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    size = int(ids.max()) + 1
    if size < 1 << 21:
        codes = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        codes = pair[:-1] * size + ids[2:]
    ordered = np.sort(codes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.isin(codes, twice)
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : len(ids) - 2 + k] |= starts
    return int(hit.sum())


def base_counts(text: str, words: list[bytes], raw: bytes, ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    spaces = len(raw) - len(raw.translate(None, _SPACE))
    return len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids)


def corpus_counts(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Bucket sums over all documents and over the trusted ones. ``trusted`` has one column, the ids."""
    name = trusted.columns[0]
    ids = trusted.filter(F.col(name).isNotNull()).select(F.col(name).alias("id")).distinct().withColumn("trusted", F.lit(True))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids  # beyond, texts are shuffled once

    def count(batches):
        known, sums = Words(), np.zeros((2, BUCKETS), np.int64)
        for batch in parts(batches, 1):
            known.trim()
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").encode().split()
                if words:
                    h = np.array([known.hashes[known[w]] for w in words], np.uint64)
                    got = np.bincount(buckets(h), minlength=BUCKETS)
                    sums[0] += got
                    if mark:
                        sums[1] += got
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["bucket", "n", "t"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left").select("trusted", "text")
    rows = src.mapInArrow(count, "bucket long, n long, t long").groupBy("bucket").agg(F.sum("n"), F.sum("t")).collect()
    out = np.zeros((2, BUCKETS), np.int64)
    for b, n, t in rows:
        out[:, b] = n, t
    return out[0], out[1]


def log_ratio(corpus: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Each bucket's log(trusted share / corpus share), both smoothed by one count; zeros without trusted counts."""
    if not trusted.sum():
        return np.zeros(len(corpus))
    return np.log((trusted + 1) / (trusted.sum() + len(trusted))) - np.log((corpus + 1) / (corpus.sum() + len(corpus)))


def judge_quality(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of every row."""
    ratio = df.sparkSession.sparkContext.broadcast(log_ratio(*corpus_counts(df, trusted, id_col, text_col)))
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    state = {}

    def score(batch: pa.RecordBatch):
        known = state.setdefault("known", Words())
        known.trim()
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            raw = text.encode()
            words = raw.split()
            ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            base = base_counts(text, words, raw, ids)
            failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
            mean = 0.0
            if words:
                h = np.array([known.hashes[i] for i in ids.tolist()], np.uint64)
                mean = float(ratio.value[buckets(h)].mean())
            rows.append((*base, failed, mean, not failed and mean >= threshold))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return arrow_map(src, score, schema).withColumnRenamed("id", id_col)
