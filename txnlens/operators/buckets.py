"""Value ranges of about equal numbers of rows, so that running sums over an order never need one task for a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_points(df: DataFrame, values: Sequence[Column], buckets: int | None = None) -> list[list]:
    """For each of the numeric ``values``, sorted cuts between ``buckets`` ranges of about equal row counts, by default one a shuffle partition.

    One pass; what reaches the driver are the cuts. A value that many rows have stands alone between two cuts.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return [[] for _ in values]
    row = df.agg(*[F.percentile_approx(v, [i / n for i in range(1, n)], 4 * n) for v in values]).first()
    return [sorted({c for c in found or [] if c == c}) for found in row]


def place(value: Column, cuts: Sequence) -> Column:
    """How many cuts the value reaches: a binary search over a literal array. Null is below all cuts."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    points = F.array(*map(F.lit, cuts))
    further = lambda at, step: F.when((at + step <= len(cuts)) & (F.get(points, at + step - 1) <= value), at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def same(a: str, b: str, columns: Sequence[str]) -> Column:
    """Join condition of two aliases on columns that may hold nulls."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`"))
    return out
