"""The row of a given rank in a global order, found by counting, never by a global sort or a one-partition window."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that one descent step may gather and sort.
SMALL = 10_000


def _pick(counts: Sequence[tuple], k: int) -> tuple:
    """Of (value, count) pairs, the value that holds rank k (from 1), the ranks before it, and its count."""
    before = 0
    for value, n in sorted(counts):
        if before + n >= k:
            return value, before, n
        before += n
    raise ValueError("the rank is beyond the rows")


def kth_text(df: DataFrame, text: Column, k: int, step: int = 4) -> str:
    """The k-th smallest value of a text column without nulls, by UTF-8 bytes.

    Rows are counted by ever longer prefixes, one aggregate a step, until those under the prefix are few. Prefixes are of
    hexadecimal digits, whose order is that of the bytes: with four more at each step, 65,793 counts at most reach the driver.
    """
    rows, prefix = df.select(F.hex(text.cast("binary")).alias("v")), ""
    n = rows.count()
    while n > SMALL:
        head = F.substring("v", 1, len(prefix) + step)
        value, before, n = _pick([tuple(r) for r in rows.groupBy(head.alias("h")).count().collect()], k)
        k, rows = k - before, rows.filter(head == value)
        if len(value) < len(prefix) + step:
            return bytes.fromhex(value).decode()  # no longer texts under this prefix
        prefix = value
    return bytes.fromhex(sorted(r[0] for r in rows.collect())[k - 1]).decode()


def kth_time(df: DataFrame, time: Column, k: int) -> tuple[datetime, int]:
    """The k-th smallest timestamp, and the rank of k among the rows of that timestamp: by hours, seconds, microseconds."""
    rows = df.select(time.cast("timestamp").alias("t"))
    for unit in ("hour", "second"):
        at = F.date_trunc(unit, "t")
        value, before, _ = _pick([tuple(r) for r in rows.groupBy(at.alias("b")).count().collect()], k)
        k, rows = k - before, rows.filter(at == F.lit(value))
    value, before, _ = _pick([tuple(r) for r in rows.groupBy("t").count().collect()], k)
    return value, k - before


def kth_row(df: DataFrame, time: str, key: str, k: int) -> tuple[datetime, str]:
    """(time, key) of the row that has rank k by time, then key."""
    t, rank = kth_time(df, F.col(time), k)
    return t, kth_text(df.filter(F.col(time).cast("timestamp") == F.lit(t)), F.col(key).cast("string"), rank)
