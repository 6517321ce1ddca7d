"""Deterministic samples: the first rows in the order of sha2(id, seed), kept by a threshold on the hash instead of a global rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import cut_points, place
from .ranks import kth_text


@dataclass(frozen=True)
class SamplingSummary:
    source_row_count: int
    sampled_row_count: int
    source_positive_count: int
    sampled_positive_count: int
    max_rows: int

    @property
    def source_negative_count(self) -> int:
        return self.source_row_count - self.source_positive_count

    @property
    def sampled_negative_count(self) -> int:
        return self.sampled_row_count - self.sampled_positive_count


def sampling_hash(seed: int, key: str = "transaction_id") -> Column:
    return F.sha2(F.concat_ws("||", F.col(key), F.lit(str(seed))), 256)


def class_counts(df: DataFrame, target: str) -> tuple[int, int]:
    """Rows and positives."""
    row = df.agg(F.count(F.lit(1)), F.count_if(F.coalesce(F.col(target) == 1, F.lit(False)))).first()
    return row[0], row[1]


def _require(df: DataFrame, target: str, key: str, max_rows: int) -> None:
    if max_rows < 1:
        raise ValueError("max_rows must be at least 1")
    if missing := {target, key} - set(df.columns):
        raise ValueError(f"sampling columns are missing: {sorted(missing)}")


def first_by_hash(df: DataFrame, n: int, seed: int, key: str = "transaction_id") -> DataFrame:
    """The n rows with the smallest hash, exactly; of rows whose key hashes to the cut, those first by all columns."""
    h = sampling_hash(seed, key)
    cut = kth_text(df, h, n)
    below, upto = df.agg(F.count_if(h < cut), F.count_if(h <= cut)).first()
    if upto == n:
        return df.filter(h <= cut)
    tied = df.filter(h == cut)
    return df.filter(h < cut).unionByName(tied.orderBy(F.xxhash64(*tied.columns), *[c for c, t in tied.dtypes if not t.startswith("map")]).limit(n - below))


def first_by_rank(df: DataFrame, n: int, seed: int, key: str = "transaction_id") -> DataFrame:
    """The plain form of ``first_by_hash``: a row number over one partition. For comparison in the benchmark only."""
    return df.withColumn("_n", F.row_number().over(Window.orderBy(sampling_hash(seed, key)))).filter(F.col("_n") <= n).drop("_n")


def keep_positives(df: DataFrame, target: str, max_rows: int, seed: int, key: str = "transaction_id") -> tuple[DataFrame, SamplingSummary]:
    """All positives, and negatives up to ``max_rows`` in all; unchanged if it fits. Rows with a null target are an error."""
    _require(df, target, key, max_rows)
    if not df.filter(F.col(target).isNull()).isEmpty():
        raise ValueError("the target holds nulls")
    n, positives = class_counts(df, target)
    if n <= max_rows:
        return df, SamplingSummary(n, n, positives, positives, max_rows)
    room = max(max_rows - positives, 0)
    out = df.filter(F.col(target) == 1)
    if room:
        out = out.unionByName(first_by_hash(df.filter(F.col(target) == 0), room, seed, key))
    kept = class_counts(out, target)
    return out, SamplingSummary(n, kept[0], positives, kept[1], max_rows)


def cap_rows(df: DataFrame, target: str, max_rows: int, seed: int, strategy: str = "exact", key: str = "transaction_id") -> tuple[DataFrame, SamplingSummary]:
    """``exact``: the first ``max_rows`` by hash. ``hash``: about as many, by a predicate on each row alone."""
    _require(df, target, key, max_rows)
    if strategy not in ("exact", "hash"):
        raise ValueError("strategy must be 'exact' or 'hash'")
    n, positives = class_counts(df, target)
    if n <= max_rows:
        return df, SamplingSummary(n, n, positives, positives, max_rows)
    if strategy == "exact":
        out = first_by_hash(df, max_rows, seed, key)
    else:
        limit = max(1, int(max_rows / n * 1_000_000))
        out = df.filter(F.pmod(F.xxhash64(sampling_hash(seed, key)), F.lit(1_000_000)) < limit)
    return out, SamplingSummary(n, (kept := class_counts(out, target))[0], positives, kept[1], max_rows)


def summarize(df: DataFrame, target: str) -> SamplingSummary:
    n, positives = class_counts(df, target)
    return SamplingSummary(n, n, positives, positives, n)


def sample_split(df: DataFrame, split: str, target: str, max_rows: int | None, seed: int, strategy: str) -> tuple[DataFrame, SamplingSummary]:
    """By a split's configured strategy: train: ``negative_sampling`` or ``none``; others: ``full``, ``exact`` or ``hash``."""
    if split == "train":
        if strategy not in ("negative_sampling", "none"):
            raise ValueError(f"unknown training strategy {strategy}")
        whole = strategy == "none"
    else:
        if strategy not in ("full", "exact", "hash"):
            raise ValueError(f"unknown evaluation strategy {strategy}")
        whole = strategy == "full"
    if whole or max_rows is None:
        return df, summarize(df, target)
    return keep_positives(df, target, max_rows, seed) if split == "train" else cap_rows(df, target, max_rows, seed, strategy)


def strided(df: DataFrame, max_rows: int, *order: str) -> DataFrame:
    """``max_rows`` rows at equal strides of the order: row int(i * n / max_rows) for each i. The first column is a number or a time."""
    n = df.count()
    if n <= max_rows:
        return df
    i = F.ceil(F.col("_n") * max_rows / F.lit(n))  # the only i whose stride can start at this row
    hit = (i < max_rows) & (F.floor(i * F.lit(n) / F.lit(max_rows)) == F.col("_n"))
    return numbered(df, "_n", *order).filter(hit).drop("_n")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Each row's number in the order, from 0, as ``name``; the first column of the order is a number or a time.

    The order is cut into ranges of the first column. Each range's count is gathered, and a row's number is its place in
    its range plus the counts before. A row's range follows from its value alone, so that a repeated task finds the same.
    An empty frame has no numbers.
    """
    first = F.unix_micros(F.col(order[0]).cast("timestamp")) if isinstance(df.schema[order[0]].dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(order[0])
    (cuts,) = cut_points(df, [first])
    ranked = df.withColumn("_p", place(first, cuts))
    before, total = {}, 0
    for p, rows in sorted(ranked.groupBy("_p").count().collect()):  # a number a range
        before[p], total = total, total + rows
    if not before:
        return df.withColumn(name, F.lit(None).cast("long"))
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair]), F.col("_p").cast("long"))
    number = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1 + offset
    return ranked.withColumn(name, number).drop("_p")


def sample_in_order(df: DataFrame, max_rows: int, seed: int, *order: str, key: str = "transaction_id", name: str = "row_index") -> DataFrame:
    """A seeded sample of ``max_rows`` rows (all if there are no more), numbered from 0 in the source's order as ``name``."""
    if max_rows < 1:
        raise ValueError("max_rows must be at least 1")
    return numbered(df if df.count() <= max_rows else first_by_hash(df, max_rows, seed, key), name, *order)
