"""Drift of current against reference rows: population stability index and Kolmogorov-Smirnov distance per numeric column, chi-square per categorical column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buckets import cut_points, place


def _long(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, side) of both frames; side 1 is current. Nulls are left out."""
    side = lambda df, s: df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.lit(s).alias("side"))
    both = side(reference, 0).unionByName(side(current, 1))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])
    return both.select("side", F.explode(pairs).alias("x")).select("side", "x.*").filter("value is not null")


def psi(reference: DataFrame, current: DataFrame, columns: Sequence[str], edges: dict[str, Sequence[float]] | None = None, bins: int = 10) -> DataFrame:
    """(feature, psi): sum over bins of (c - r) ln(c / r), with half a row added to each bin's count.

    Bins are cut at ``edges``, by default at approximate deciles of the reference.
    """
    if edges is None:
        found = reference.select(*[F.col(c).cast("double").alias(c) for c in columns]).approxQuantile(list(columns), [i / bins for i in range(1, bins)], 0.001)
        edges = {c: sorted(set(e)) for c, e in zip(columns, found, strict=True)}
    place = F.lit(None).cast("int")
    for c in columns:
        place = F.when(F.col("feature") == c, sum((F.when(F.col("value") >= float(e), 1).otherwise(0) for e in edges[c]), F.lit(0))).otherwise(place)
    counts = _long(reference, current, columns).groupBy("feature", place.alias("bin")).agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))
    size = F.lit(None).cast("int")
    for c in columns:
        size = F.when(F.col("feature") == c, len(edges[c]) + 1).otherwise(size)
    # empty bins add nothing but their half rows, which the missing bins' number accounts for
    per = counts.groupBy("feature").agg(F.collect_list(F.struct("r", "c")).alias("x"), F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.count(F.lit(1)).alias("k")).withColumn("b", size)
    share = lambda n, total: (n + 0.5) / (total + 0.5 * F.col("b"))
    term = lambda r, c: (share(c, F.col("nc")) - share(r, F.col("nr"))) * F.log(share(c, F.col("nc")) / share(r, F.col("nr")))
    value = F.aggregate("x", F.lit(0.0), lambda a, x: a + term(x["r"], x["c"])) + (F.col("b") - F.col("k")) * term(F.lit(0), F.lit(0))
    return per.select("feature", value.alias("psi"))


def psi_by(reference: DataFrame, current: DataFrame, by: Sequence[str], columns: Sequence[str], edges: dict[str, Sequence[float]]) -> DataFrame:
    """(by, feature, row_count, psi) of each group of the current rows against all reference rows, as ``psi``; all groups in one pass.

    What is joined holds one map of bin counts a feature, and a group and feature. Nulls are left out.
    """
    at = size = F.lit(None).cast("int")
    for c in columns:
        at = F.when(F.col("feature") == c, sum((F.when(F.col("value") >= float(e), 1).otherwise(0) for e in edges[c]), F.lit(0))).otherwise(at)
        size = F.when(F.col("feature") == c, len(edges[c]) + 1).otherwise(size)

    def counted(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
        rows = df.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*").filter("value is not null")
        bins = rows.groupBy(*keys, "feature", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        return bins.groupBy(*keys, "feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias(name), F.sum("n").alias(f"{name}_total"))

    both = counted(current, by, "c").join(counted(reference, (), "r"), "feature", "left").withColumn("b", size)
    share = lambda m, i: (F.coalesce(F.try_element_at(m, i), F.lit(0)) + 0.5) / (F.coalesce(F.col(f"{m}_total"), F.lit(0)) + 0.5 * F.col("b"))

    def term(i: Column) -> Column:
        c, r = share("c", i), share("r", i)
        return (c - r) * F.log(c / r)

    value = F.aggregate(F.sequence(F.lit(0), F.col("b") - 1), F.lit(0.0), lambda a, i: a + term(i))
    return both.select(*by, "feature", F.col("c_total").alias("row_count"), value.alias("psi"))


def ks(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, ks): the largest gap between the two distribution functions, over distinct values.

    Each feature's values are cut into ranges; counts run within a range, and the ranges' totals give what lies below it.
    """
    number = [F.col(c).cast("double").alias(c) for c in columns]
    both = reference.select(*number).unionByName(current.select(*number))
    cuts = dict(zip(columns, cut_points(both, [F.col(c) for c in columns]), strict=True))
    at = F.lit(None).cast("int")
    for c in columns:
        at = F.when(F.col("feature") == c, place(F.col("value"), cuts[c])).otherwise(at)
    counts = _long(reference, current, columns).groupBy("feature", "value").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c")).withColumn("range", at)
    keys = ["feature", "range"]
    lower, whole = Window.partitionBy("feature").orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("feature")  # a row a range
    sums = counts.groupBy(*keys).agg(F.sum("r").alias("sr"), F.sum("c").alias("sc"))
    below = lambda c: F.coalesce(F.sum(c).over(lower), F.lit(0))
    ranges = sums.select(*keys, below("sr").alias("br"), below("sc").alias("bc"), F.sum("sr").over(whole).cast("double").alias("nr"), F.sum("sc").over(whole).cast("double").alias("nc"))
    up = Window.partitionBy(*keys).orderBy("value")
    running = counts.select(*keys, F.sum("r").over(up).alias("ur"), F.sum("c").over(up).alias("uc")).join(ranges, keys)
    gap = F.abs(F.try_divide(F.col("br") + F.col("ur"), F.col("nr")) - F.try_divide(F.col("bc") + F.col("uc"), F.col("nc")))
    return running.groupBy("feature").agg(F.max(gap).alias("ks"))


def chi_square(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, chi_square, degrees) of the 2 x categories table of counts; null is a category. Null if a side has no rows.

    The statistic is N^2 / (R C) (sum of r^2 / (r + c) - R^2 / N), so one sum over the categories is enough.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("x")
    side = lambda df, s: df.select(pairs, F.lit(s).alias("side"))
    counts = side(reference, 0).unionByName(side(current, 1)).groupBy("x.feature", "x.value").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    sums = counts.groupBy("feature").agg(F.sum(r).alias("nr"), F.sum(c).alias("nc"), F.sum(r * r / (r + c)).alias("q"), (F.count(F.lit(1)) - 1).alias("degrees"))
    n = F.col("nr") + F.col("nc")
    return sums.select("feature", F.try_divide(n * n * (F.col("q") - F.col("nr") * F.col("nr") / n), F.col("nr") * F.col("nc")).alias("chi_square"), "degrees")
