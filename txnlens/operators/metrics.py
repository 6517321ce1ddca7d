"""Operational time series: rates, ratios, increases and histogram quantiles over a long table (ts, series labels, value)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buckets import same

# Upper bounds of the latency histogram's buckets, in seconds.
LATENCY_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0)


# Seconds of the units that window lengths are given in.
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def seconds_of(length: str) -> int:
    """Seconds of a length such as ``5 minutes``."""
    n, unit = length.split()
    return int(n) * _UNITS[unit.removesuffix("s")]


def windowed(rows: DataFrame, by: Sequence[str], sums: dict[str, Column], window: str, ts: str, step: str | None = None, merge: Callable[[str], Column] = F.sum) -> DataFrame:
    """(window_start, by, sums) of windows of a length, one every ``step``; without a step they don't overlap.

    Overlapping windows are put together from panes of one step: rows are aggregated once, into the pane they are in, and
    panes, not rows, go to the windows that hold them. ``merge`` adds up a column of panes. Where the step does not divide
    the length, rows are copied into their windows.
    """
    if step is None or seconds_of(window) % seconds_of(step):
        w = F.window(ts, window, step) if step else F.window(ts, window)
        return rows.groupBy(w.alias("w"), *by).agg(*[c.alias(n) for n, c in sums.items()]).select(F.col("w.start").alias("window_start"), *by, *sums)
    panes = rows.groupBy(F.window(ts, step).alias("w"), *by).agg(*[c.alias(n) for n, c in sums.items()])
    earlier = F.col("w.start") - F.make_dt_interval(secs=F.lit(seconds_of(window) - seconds_of(step)))
    spread = panes.select(F.explode(F.sequence(earlier, F.col("w.start"), F.make_dt_interval(secs=F.lit(seconds_of(step))))).alias("window_start"), *by, *sums)
    return spread.groupBy("window_start", *by).agg(*[merge(n).alias(n) for n in sums])


def increases(samples: DataFrame, by: Sequence[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Counter samples with ``delta`` to the sample before of their series; after a reset the value itself, 0 for a first sample.

    Samples are put in order within a day of their series; the last sample of the day before, one row a day, comes by a
    join. So one task holds a day of a series. Samples without a time or a value are left out; equal times go by value.
    """
    rows = samples.filter(F.col(ts).isNotNull() & F.col(value).isNotNull()).withColumn("_day", F.to_date(ts))
    days = rows.groupBy(*by, "_day").agg(F.max(F.struct(ts, value)).alias("last"))
    days = days.select(*by, "_day", F.lag("last").over(Window.partitionBy(*by).orderBy("_day")).getField(value).alias("_earlier"))
    joined = rows.alias("r").join(days.alias("d"), same("r", "d", [*by, "_day"])).select("r.*", "d._earlier")
    before = F.coalesce(F.lag(value).over(Window.partitionBy(*by, "_day").orderBy(ts, value)), F.col("_earlier"))
    delta = F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return joined.withColumn("delta", delta).drop("_day", "_earlier")


def counter_rate(samples: DataFrame, by: Sequence[str], window: str = "5 minutes", ts: str = "ts", step: str | None = None) -> DataFrame:
    """(window_start, by, increase, per second) of each window, tumbling or one every ``step``."""
    out = windowed(increases(samples, by, ts), by, {"increase": F.sum("delta")}, window, ts, step)
    return out.withColumn("rate", F.col("increase") / seconds_of(window))


def extrapolated_rate(samples: DataFrame, by: Sequence[str], window: str = "5 minutes", ts: str = "ts", value: str = "value", step: str | None = None) -> DataFrame:
    """(window_start, by, samples, increase, rate): a counter's rate from a window's own samples, stretched to its borders.

    The increase between a window's first and last sample, resets made good, is multiplied by (covered + before + after) /
    covered. ``before`` and ``after`` are the gaps to the window's borders, or half the mean distance of samples where a gap
    is 1.1 times that distance or more; before is no longer than the counter takes from zero at this pace. Windows with one
    sample, or samples of one instant, have no rate.
    """
    rows = increases(samples, by, ts, value)
    first = F.struct(F.col(ts).alias("at"), F.col(value).cast("double").alias("value"), "delta")
    merge = lambda c: {"first": F.min, "last": F.max}.get(c, F.sum)(c)
    w = windowed(rows, by, {"first": F.min(first), "last": F.max(ts), "total": F.sum("delta"), "samples": F.count(F.lit(1))}, window, ts, step, merge)
    micro = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    w = w.withColumns({"increase": F.col("total") - F.col("first.delta"), "_from": micro(F.col("first.at")), "_to": micro(F.col("last")), "_start": micro(F.col("window_start"))})
    w = w.withColumn("_covered", F.col("_to") - F.col("_from")).filter("samples > 1 and _covered > 0")
    mean = F.col("_covered") / (F.col("samples") - 1)
    gap = lambda g: F.when(g >= 1.1 * mean, mean / 2).otherwise(g)
    zero = F.when((F.col("increase") > 0) & (F.col("first.value") >= 0), F.col("_covered") * F.col("first.value") / F.col("increase"))
    before, after = F.least(gap(F.col("_from") - F.col("_start")), zero), gap(F.col("_start") + seconds_of(window) - F.col("_to"))
    stretched = F.col("increase") * (F.col("_covered") + before + after) / F.col("_covered")
    return w.select("window_start", *by, "samples", stretched.alias("increase"), (stretched / seconds_of(window)).alias("rate"))


def event_rate(events: DataFrame, by: Sequence[str] = (), window: str = "5 minutes", ts: str = "ts", step: str | None = None) -> DataFrame:
    """(window_start, by, requests, per second) of rows that each are one event."""
    return windowed(events, by, {"requests": F.count(F.lit(1))}, window, ts, step).withColumn("rate", F.col("requests") / seconds_of(window))


def error_ratio(events: DataFrame, is_error: Column, window: str = "5 minutes", ts: str = "ts", floor: float = 1e-9, limit: float = 0.02, step: str | None = None) -> DataFrame:
    """(window_start, requests, errors, ratio, firing): errors a request, the denominator clamped from below."""
    out = windowed(events, (), {"requests": F.count(F.lit(1)), "errors": F.count_if(is_error)}, window, ts, step)
    ratio = F.col("errors") / F.greatest(F.col("requests").cast("double"), F.lit(floor))
    return out.select("window_start", "requests", "errors", ratio.alias("ratio"), (ratio > limit).alias("firing"))


def histogram_quantile(events: DataFrame, value: str, q: float = 0.95, buckets: Sequence[float] = LATENCY_BUCKETS, window: str = "5 minutes", ts: str = "ts", step: str | None = None) -> DataFrame:
    """(window_start, requests, quantile): linear within the bucket that holds rank q n; beyond the last bound, that bound."""
    counts = {f"le{i}": F.count_if(F.col(value) <= b) for i, b in enumerate(buckets)}
    out = windowed(events, (), {"requests": F.count(F.lit(1)), **counts}, window, ts, step)
    rank, quantile = q * F.col("requests"), F.lit(float(buckets[-1]))
    for i in range(len(buckets) - 1, -1, -1):
        low, below = (buckets[i - 1], F.col(f"le{i - 1}")) if i else (0.0, F.lit(0))
        share = F.try_divide((rank - below).cast("double"), (F.col(f"le{i}") - below).cast("double"))
        quantile = F.when(F.col(f"le{i}") >= rank, F.lit(float(low)) + (float(buckets[i]) - float(low)) * F.coalesce(share, F.lit(0.0))).otherwise(quantile)
    return out.select("window_start", "requests", quantile.alias("quantile"))


def alert_states(firing: DataFrame, hold: str = "10 minutes", step: str = "1 minute", by: Sequence[str] = (), start: str = "window_start", flag: str = "firing") -> DataFrame:
    """``firing`` with ``active_since`` and ``state``: inactive, pending until the flag has held for ``hold``, then firing.

    Evaluations are ``step`` apart; where one is missing the flag did not hold. An island of evaluations that follow each
    other begins where the one before is missing or did not fire. Evaluations are put in order within a day; what a day
    takes from earlier ones, its last evaluation and latest beginning, is one row a day. A null flag did not hold.
    """
    on = F.coalesce(F.col(flag), F.lit(False))
    rows = firing.withColumn("_day", F.to_date(start)).withColumn("_on", on)
    keys = [*by, "_day"]
    within, days = Window.partitionBy(*keys).orderBy(start), Window.partitionBy(*by).orderBy("_day")
    last = rows.groupBy(*keys).agg(F.max(F.struct(F.col(start).alias("at"), "_on")).alias("x")).select(*keys, F.lag("x").over(days).alias("_earlier"))
    rows = rows.alias("r").join(last.alias("d"), same("r", "d", keys)).select("r.*", "d._earlier")
    before = F.coalesce(F.lag(F.struct(F.col(start).alias("at"), "_on")).over(within), F.col("_earlier"))
    follows = F.coalesce(before["_on"] & (before["at"] + F.make_dt_interval(secs=F.lit(seconds_of(step))) == F.col(start)), F.lit(False))
    rows = rows.withColumn("_begins", F.when(F.col("_on") & ~follows, F.col(start)))
    latest = rows.groupBy(*keys).agg(F.max("_begins").alias("x")).select(*keys, F.max("x").over(days.rowsBetween(Window.unboundedPreceding, -1)).alias("_latest"))
    rows = rows.alias("r").join(latest.alias("d"), same("r", "d", keys)).select("r.*", "d._latest")
    since = F.when(F.col("_on"), F.coalesce(F.max("_begins").over(within), F.col("_latest")))
    held = F.col("active_since") + F.make_dt_interval(secs=F.lit(seconds_of(hold))) <= F.col(start)
    out = rows.withColumn("active_since", since).withColumn("state", F.when(~F.col("_on"), "inactive").when(held, "firing").otherwise("pending"))
    return out.select(*firing.columns, "active_since", "state")
