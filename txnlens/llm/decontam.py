"""Benchmark decontamination with an FM-index over each shard of the corpus.

A shard is the word stream of a few megabytes of documents. Its alphabet is the benchmark's vocabulary; every other word,
and every end of a document, is a separator, and separators are all different, so that the suffix order is that of one
string and LF steps are exact. The index holds the Burrows-Wheeler transform as a wavelet matrix with rank counts and the
text positions of sampled suffixes. All distinct benchmark windows are searched backwards together, one word of each at a
time; the rows of those that remain are walked to the next sampled position; the located spans are merged.

The benchmark reaches the workers in blocks of ``BLOCK_WORDS`` words, each a step of one narrow scan; the driver reads one
block at a time, and after ``BLOCKS`` of them the rows so far are written to the shared folder and their broadcasts go, so
that what is broadcast stays bounded for any benchmark. Nothing is shuffled.

Defined cases: a null or empty text has no words and no hit. An item without words has no window. Windows never cross the
end of a document. Rows of one id are judged one by one; items that share an id count once; an item without an id can hit
but is not listed. An empty benchmark or corpus gives no hits or no rows. Extra columns are ignored by ``find_spans`` and
kept by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, parts, suffix_array

WINDOW = 13
#: Benchmark words in one broadcast at most, unless one item is longer.
BLOCK_WORDS = 500_000
#: Bytes that a word stands for where the benchmark is cut in partitions of a block each.
WORD_BYTES = 8
#: Blocks that are broadcast at once at most.
BLOCKS = 4
#: Words of a shard at most.
SHARD_WORDS = 1 << 20
#: Every so many text positions a suffix keeps its position.
SAMPLE = 16
#: ASCII letters and digits, lower-cased, and all bytes of other characters are words; the rest separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


class WaveletMatrix:
    """Rank over a sequence of symbols: one bit vector a level, with running counts of zeros."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1 == 0
            run = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=run[1:])
            self.zeros.append(run)
            symbols = np.concatenate([symbols[bit], symbols[~bit]])
        self.starts = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, run in zip(range(self.levels - 1, -1, -1), self.zeros, strict=True):
            low = run[at]
            at = np.where((symbol >> level) & 1, run[-1] + at - low, low)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._walk(symbol, at) - self.starts[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for run in self.zeros:
            low = run[at]
            one = run[at + 1] == low
            at = np.where(one, run[-1] + at - low, low)
            symbol = symbol * 2 + one
        return symbol, at - self.starts[symbol]


class FMIndex:
    """``seq``: symbols from 1 to sigma - 1, 0 for separators; the last is a separator."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        n = len(seq)
        sa, self.first = suffix_array(seq, sigma)
        bwt = seq[sa - 1]  # before the first position stands the last, a separator
        self.bwt = WaveletMatrix(bwt, sigma)
        marked = (bwt == 0) | (sa % sample == 0)
        self.marks = np.zeros(n + 1, np.int32)
        np.cumsum(marked, out=self.marks[1:])
        self.samples = sa[marked].astype(np.int32)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each pattern; those that occur: their numbers, lo, hi."""
        alive = np.arange(len(patterns))
        last = patterns[:, -1]
        lo, hi = self.first[last], self.first[last + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            some = lo < hi
            alive, lo, hi = alive[some], lo[some], hi[some]
            if not len(alive):
                break
            c = patterns[alive, k]
            lo, hi = self.first[c] + self.bwt.rank(c, lo), self.first[c] + self.bwt.rank(c, hi)
        some = lo < hi
        return alive[some], lo[some], hi[some]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a sampled one, and add the steps."""
        out, at, todo, steps = np.empty(len(rows), np.int64), rows, np.arange(len(rows)), 0
        while len(todo):
            known = self.marks[at + 1] > self.marks[at]
            out[todo[known]] = self.samples[self.marks[at[known]]] + steps
            todo, at, steps = todo[~known], at[~known], steps + 1
            if len(todo):
                symbol, rank = self.bwt.access(at)
                at = self.first[symbol] + rank
        return out


class Benchmark:
    """The windows of some items, as symbols of their own vocabulary, grouped by length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.symbol: dict[bytes, int] = {}
        self.names: list[str | None] = []
        owners: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            ids = [self.symbol.setdefault(w, len(self.symbol) + 1) for w in words_of(text)]
            if ids:
                self.names.append(name)
                for k in range(max(1, len(ids) - window + 1)):
                    owners.setdefault(tuple(ids[k : k + window]), set()).add(len(self.names) - 1)
        self.sigma = len(self.symbol) + 1
        self.groups: list[tuple[np.ndarray, list[np.ndarray]]] = []
        for n in sorted({len(w) for w in owners}):
            own = [w for w in owners if len(w) == n]
            self.groups.append((np.array(own, np.int64), [np.array(sorted(owners[w])) for w in own]))

    def hits(self, texts: list[str | None]) -> list[tuple[int, list[int], list[int], list[str]]]:
        """For each text: words, starts and ends of the merged spans in words, names of the items that occur."""
        get, streams, sizes = self.symbol.get, [], []
        for text in texts:
            ws = words_of(text)
            sizes.append(len(ws))
            streams.append(np.fromiter((get(w, 0) for w in ws), np.int64, len(ws)))
            streams.append(np.zeros(1, np.int64))
        begin = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
        seq = np.concatenate(streams) if streams else np.zeros(0, np.int64)
        delta, found = np.zeros(len(seq) + 1, np.int64), [np.zeros((0, 2), np.int64)]
        step = SHARD_WORDS - self.window
        for at in range(0, len(seq), step):  # shards overlap by a window less one word
            shard = seq[at : at + step + self.window - 1]
            if not shard.any():
                continue
            index = FMIndex(np.append(shard, 0), self.sigma)
            for patterns, owners in self.groups:
                which, lo, hi = index.search(patterns)
                if len(which):
                    many = hi - lo
                    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                    p = index.locate(rows) + at
                    np.add.at(delta, p, 1)
                    np.add.at(delta, p + patterns.shape[1], -1)
                    doc = np.searchsorted(begin, p, side="right") - 1
                    pair = np.unique(np.repeat(which, many) * len(texts) + doc)
                    found += [np.stack([np.full(len(owners[w]), d), owners[w]], 1) for w, d in zip(pair // len(texts), pair % len(texts), strict=True)]
        edge = np.diff((np.cumsum(delta[:-1]) > 0).astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        doc = np.searchsorted(begin, starts, side="right") - 1
        out: list[tuple[int, list[int], list[int], list[str]]] = [(n, [], [], []) for n in sizes]
        for d, s, e in zip(doc.tolist(), starts.tolist(), ends.tolist(), strict=True):
            out[d][1].append(s - int(begin[d]))
            out[d][2].append(e - int(begin[d]))
        for d, item in np.unique(np.concatenate(found), axis=0).tolist():
            if self.names[item] is not None:
                out[d][3].append(self.names[item])
        return out


def blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of bounded size, read one partition at a time; a partition holds about a block."""
    chosen = items.select(F.col(id_col).cast("string"), F.col(text_col))
    n_bytes = chosen.agg(F.sum(F.octet_length(chosen[1]))).first()[0] or 0
    if n_bytes > WORD_BYTES * block_words:
        chosen = chosen.repartition(n_bytes // (WORD_BYTES * block_words) + 1)
    block: list[tuple[str | None, str | None]] = []
    size = 0
    for row in chosen.toLocalIterator():
        n = (row[1] or "").count(" ") + 1
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    yield block


def _union(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def find_spans(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(id, n_words, starts, ends, items): merged spans of words that benchmark windows cover, and the items they are of."""
    none = F.array()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), none.cast("array<long>").alias("starts"), none.cast("array<long>").alias("ends"), none.cast("array<string>").alias("items"))
    schema = out.schema
    coming, held, written = blocks(items, item_id_col, item_text_col, block_words), [], None
    block, k = next(coming), 0
    while block is not None:
        shared, following = docs.sparkSession.sparkContext.broadcast(block), next(coming, None)
        held.append(shared)

        def run(batches, shared=shared, last=following is None, first=k == 0):
            bench = Benchmark(shared.value, window)
            for batch in parts(batches, 1):
                texts = batch.column(1).to_pylist()
                new = bench.hits(texts)
                if not first:
                    for i, (s, e, it) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True)):
                        n, s1, e1, it1 = new[i]
                        new[i] = (n, *_union([*zip(s, e, strict=True), *zip(s1, e1, strict=True)]), [*it, *it1])
                cols = [pa.array([r[c] for r in new], t) for c, t in ((0, pa.int64()), (1, pa.list_(pa.int64())), (2, pa.list_(pa.int64())), (3, pa.list_(pa.string())))]
                text = pa.nulls(batch.num_rows, pa.string()) if last else batch.column(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), text, *cols], names=["id", "text", "n_words", "starts", "ends", "items"])

        out = out.mapInArrow(run, schema)
        block, k = following, k + 1
        if block is not None and k % BLOCKS == 0:
            before, written = written, materialize(out)
            out = written
            if before is not None:
                forget(before)
            while held:
                held.pop().destroy()
    return out.select(F.col("id").alias(id_col), "n_words", "starts", "ends", F.sort_array(F.array_distinct("items")).alias("items"))


def judged(spans: DataFrame) -> DataFrame:
    """Spans with n_hit, n_items, items_sha256 and contaminated (a hit on at least a twentieth of the words)."""
    hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        spans.withColumn("n_hit", hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, all columns, without those that ``judged`` calls contaminated."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    spans = judged(find_spans(rows, items, "row", "text", item_id_col, item_text_col, window, block_words))
    return spans.filter(~F.col("contaminated")).select("row.*")
