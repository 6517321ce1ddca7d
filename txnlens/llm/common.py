"""What the operators share: materialisation in shared storage, Arrow batches of bounded size, safe column names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Settings of the queries that operators run themselves: what is left of each is a table or rows of the driver, so that
#: its shuffle files can go when it ends; Arrow batches hold bytes, not rows, of a bounded number.
_OWN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and driver and executors are one process, a folder of our own, removed when the process ends.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = getattr(spark.sparkContext, "_txnlens_shared", None)
        if not at:
            at = spark.sparkContext._txnlens_shared = tempfile.mkdtemp(prefix="txnlens-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at.rstrip("/")


@contextmanager
def own_query(spark: SparkSession):
    """Within it, queries run under the settings above."""
    before = {k: spark.conf.get(k) for k in _OWN}
    for k, v in _OWN.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it: lineage ends there, and lost executors cost no recomputation.

    The query's shuffle files are removed; the table stays until ``forget``, or as long as the shared folder.
    """
    path = f"{shared_folder(df.sparkSession)}/txnlens-{uuid.uuid4().hex}"
    with own_query(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._txnlens_path = path
    if (noted := _noted.get()) is not None:
        noted.append(out)
    return out


_noted: ContextVar[list[DataFrame] | None] = ContextVar("_noted", default=None)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], None]]:
    """Owns the tables that ``materialize`` writes within it and deletes them at its end, but for those handed to the function that it gives.

    Those belong to the block around it, if there is one. A result that is not written within the block reads tables that
    are gone.
    """
    tables: list[DataFrame] = []
    stay: list[DataFrame] = []
    token = _noted.set(tables)
    try:
        yield stay.append
    finally:
        _noted.reset(token)
        forget(*[t for t in tables if all(t is not s for s in stay)])
        if (around := _noted.get()) is not None:
            around.extend(stay)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and nothing reads any more, through the file system that holds them."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._txnlens_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def hashed_sample(df: DataFrame, max_rows: int, *keys: str) -> DataFrame:
    """About ``max_rows`` rows at most, one of each distinct hash of ``keys``: those whose hash is under a threshold.

    The threshold follows from the row count, so that no task has to hand more than its share to the driver; copies of a
    row count once. All rows if there are no more than ``max_rows``.
    """
    h = F.xxhash64(*keys)
    n = df.count()
    cut = -(1 << 63) + (1 << 64) * max_rows // n if n > max_rows else (1 << 63) - 1
    return df.withColumn("_h", h).filter(F.col("_h") <= F.lit(cut)).dropDuplicates(["_h"]).drop("_h")


def utf8(name: str | Column) -> Column:
    """A text column as a string without nulls."""
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))


_kept: dict = {}


def kept[T](key: object, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task under ``key``, until an operator that keeps something else, or nothing, runs there."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def parts(batches: Iterable[pa.RecordBatch], text: int | tuple[int, ...], max_bytes: int = 4 << 20, keeps: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each piece stay under ``max_bytes`` (one longer text makes a piece of its own).

    Unless the operator ``keeps`` something itself, what another left in the worker is dropped.
    """
    if not keeps:
        _kept.clear()
    for batch in batches:
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in ((text,) if isinstance(text, int) else text))
        start = total = 0
        for i, n in enumerate(sizes.tolist()):
            if n and total + n > max_bytes and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


def bucket_counts(df: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], counters: int, text: int | None = None) -> np.ndarray:
    """How many of the 64-bit ``values`` of all batches fall in each of ``counters`` buckets (a power of two), by their low bits.

    Each task sums its own buckets; sums meet by chunks of buckets. 8 bytes a bucket, compressed, reach the driver, whatever the input.
    """
    chunk = min(counters, 1 << 12)

    def count(batches):
        sums = np.zeros(counters, np.int64)
        for batch in batches if text is None else parts(batches, text):
            sums += np.bincount(values(batch) & (counters - 1), minlength=counters)
        some = sums.reshape(-1, chunk)
        used = np.flatnonzero(some.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([pa.compress(some[k].tobytes(), codec="zstd", asbytes=True) for k in used], pa.binary())], names=["chunk", "n"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(pa.decompress(n, 8 * chunk, codec="zstd", asbytes=True), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([pa.compress(v.tobytes(), codec="zstd", asbytes=True) for v in sums.values()], pa.binary())], names=["chunk", "n"])

    out = np.zeros((counters // chunk, chunk), np.int64)
    with own_query(df.sparkSession):
        sums = df.mapInArrow(count, "chunk long, n binary").repartition("chunk").mapInArrow(add, "chunk long, n binary").collect()
    for k, n in sums:
        out[k] += np.frombuffer(pa.decompress(n, 8 * chunk, codec="zstd", asbytes=True), np.int64)
    return out.reshape(-1)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, text: int = 1, max_bytes: int = 4 << 20, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` over pieces of bounded text size; ``text`` is the position of the text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in parts(batches, text, max_bytes, keeps):
            yield from fn(piece)

    return df.mapInArrow(run, schema)


def suffix_array(seq: np.ndarray, sigma: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of symbols below ``sigma`` by prefix doubling, and how many symbols are smaller than each (sigma + 1 counts).

    Zeros are separators: all different, ordered by position, smaller than other symbols. The last symbol must be one.
    A sort key packs two ranks and a position of 21 bits each, so ``seq`` has at most 2^21 symbols.
    """
    n = len(seq)
    if n > 1 << 21:
        raise ValueError("split the sequence: a suffix array covers 2^21 symbols at most")
    sep = seq == 0
    counts = np.bincount(seq, minlength=sigma)
    first = np.concatenate([[0], np.cumsum(counts)])
    rank = first[seq]
    rank[sep] = np.arange(counts[0])
    active, step = np.flatnonzero(~sep & (counts[seq] > 1)), 1
    while len(active):  # groups of suffixes that share their first ``step`` symbols
        key = (rank[active] << 42) | (rank[active + step] << 21) | active
        key.sort()
        at, second, group = key & 0x1FFFFF, key >> 21 & 0x1FFFFF, key >> 42
        new_group = np.empty(len(at), bool)
        new_group[0] = True
        np.not_equal(group[1:], group[:-1], out=new_group[1:])
        new = new_group.copy()
        new[1:] |= second[1:] != second[:-1]
        order = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(new, order, 0))
        rank[at] = group + begin - np.maximum.accumulate(np.where(new_group, order, 0))
        alone = new.copy()
        alone[:-1] &= new[1:]
        active, step = at[~alone], step * 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa, first
