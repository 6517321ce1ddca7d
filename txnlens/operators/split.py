"""Chronological train / validation / test splits: pure filters on cut points, so the rows themselves are never shuffled."""

from __future__ import annotations

from functools import reduce
from math import isclose

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import kth_row

SPLITS = ("train", "validation", "test")


def check_ratios(train: float, validation: float, test: float) -> None:
    if any(not 0 < r < 1 for r in (train, validation, test)):
        raise ValueError("split ratios must be greater than 0 and less than 1")
    if not isclose(train + validation + test, 1.0, abs_tol=1e-9):
        raise ValueError("split ratios must sum to 1.0")


def split_sizes(n: int, train: float, validation: float) -> tuple[int, int]:
    """Ranks at which train and validation end."""
    first = int(n * train)
    second = first + int(n * validation)
    if n < 3:
        raise ValueError("at least three rows are needed for three splits")
    if first == 0 or second == first or second >= n:
        raise ValueError("the ratios leave a split empty")
    return first, second


def _by_cuts(df: DataFrame, until_train: Column, until_validation: Column) -> dict[str, DataFrame]:
    return {"train": df.filter(until_train), "validation": df.filter(~until_train & until_validation), "test": df.filter(~until_validation)}


def split_exact(df: DataFrame, train: float, validation: float, test: float, time: str = "timestamp", key: str = "transaction_id") -> dict[str, DataFrame]:
    """Exact row counts in the order (time, key). Keys are unique and, like times, not null, which validation ensures before."""
    check_ratios(train, validation, test)

    def until(rank: int) -> Column:
        t, k = kth_row(df, time, key, rank)
        at = F.col(time).cast("timestamp")
        return (at < F.lit(t)) | ((at == F.lit(t)) & (F.col(key).cast("string") <= k))

    return _by_cuts(df, *map(until, split_sizes(df.count(), train, validation)))


def split_exact_by_window(df: DataFrame, train: float, validation: float, test: float, time: str = "timestamp", key: str = "transaction_id") -> dict[str, DataFrame]:
    """The plain form of ``split_exact``: a row number over one partition. For comparison in the benchmark only."""
    check_ratios(train, validation, test)
    first, second = split_sizes(df.count(), train, validation)
    numbered = df.withColumn("_n", F.row_number().over(Window.orderBy(time, key)))
    return {k: v.drop("_n") for k, v in _by_cuts(numbered, F.col("_n") <= first, F.col("_n") <= second).items()}


def split_by_time(df: DataFrame, train: float, validation: float, test: float, time: str = "timestamp", key: str = "transaction_id", error: float = 0.01) -> dict[str, DataFrame]:
    """Cuts at approximate quantiles of the time, ties going to the earlier split; exact where that leaves a split empty."""
    check_ratios(train, validation, test)
    if not 0 <= error <= 1:
        raise ValueError("the quantiles' relative error must be between 0 and 1")
    at = F.col(time).cast("timestamp").cast("double")
    cuts = df.select(at.alias("t")).approxQuantile("t", [train, train + validation], error)
    if len(cuts) == 2 and cuts[0] < cuts[1]:
        splits = _by_cuts(df, at <= cuts[0], at <= cuts[1])
        if not any(s.isEmpty() for s in splits.values()):
            return splits
    return split_exact(df, train, validation, test, time, key)


def chronological_split(df: DataFrame, train: float, validation: float, test: float, strategy: str = "exact", error: float = 0.01) -> dict[str, DataFrame]:
    if missing := {"transaction_id", "timestamp"} - set(df.columns):
        raise ValueError(f"split columns are missing: {sorted(missing)}")
    if strategy == "exact":
        return split_exact(df, train, validation, test)
    if strategy == "time_boundary":
        return split_by_time(df, train, validation, test, error=error)
    raise ValueError("strategy must be 'exact' or 'time_boundary'")


def tagged(splits: dict[str, DataFrame]) -> DataFrame:
    """All splits in one frame with their name as ``split``."""
    return reduce(DataFrame.unionByName, [df.withColumn("split", F.lit(name)) for name, df in splits.items()])


def split_stats(splits: dict[str, DataFrame], time: str = "timestamp", target: str = "is_fraud") -> DataFrame:
    """One row a split that has rows: rows, targets that are null or not 0 or 1, first and last time."""
    invalid = F.coalesce(~F.col(target).isin(0, 1), F.lit(True))
    return tagged(splits).groupBy("split").agg(F.count(F.lit(1)).alias("row_count"), F.count_if(invalid).alias("invalid_target_count"), F.min(time).alias("min_timestamp"), F.max(time).alias("max_timestamp"))


def overlaps(splits: dict[str, DataFrame], key: str = "transaction_id") -> DataFrame:
    """Keys that each two splits share (pair, overlap_count): one pass over all keys instead of three joins."""
    pairs = [(a, b) for i, a in enumerate(SPLITS) for b in SPLITS[i + 1 :]]
    keyed = tagged({n: s.select(key) for n, s in splits.items()}).groupBy(key).agg(*[F.max((F.col("split") == n).cast("int")).alias(n) for n in SPLITS])
    sums = keyed.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}__{b}") for a, b in pairs])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f"{a}__{b}").alias("pair"), F.col(f"{a}__{b}").alias("overlap_count")) for a, b in pairs])).alias("x")).select("x.*")


def split_findings(source: DataFrame, splits: dict[str, DataFrame], time: str = "timestamp", key: str = "transaction_id", target: str = "is_fraud") -> DataFrame:
    """One row: the source's rows, each split's rows and time range, bad targets, and keys that occur more than once."""
    invalid = F.coalesce(~F.col(target).isin(0, 1), F.lit(True))
    rows = tagged({n: s.select(F.col(key).alias("key"), F.col(time).alias("time"), invalid.alias("invalid")) for n, s in splits.items()})
    of = lambda n, c: F.when(F.col("split") == n, F.col(c))
    each = [x for n in SPLITS for x in (F.count_if(F.col("split") == n).alias(f"{n}_row_count"), F.min(of(n, "time")).alias(f"{n}_min"), F.max(of(n, "time")).alias(f"{n}_max"), F.count_if((F.col("split") == n) & F.col("invalid")).alias(f"{n}_invalid"))]
    keyed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *each)
    sums = [x for n in SPLITS for x in (F.coalesce(F.sum(f"{n}_row_count"), F.lit(0)).alias(f"{n}_row_count"), F.min(f"{n}_min").alias(f"{n}_min_timestamp"), F.max(f"{n}_max").alias(f"{n}_max_timestamp"), F.coalesce(F.sum(f"{n}_invalid"), F.lit(0)).alias(f"{n}_invalid_target_count"))]
    found = keyed.agg(F.count_if(F.col("n") > 1).alias("duplicate_transaction_id_count"), *sums)
    total = source.agg(F.count(F.lit(1)).alias("total_row_count"))
    return found.withColumn("total_row_count", total.scalar())


def validate_splits(source: DataFrame, splits: dict[str, DataFrame], time: str = "timestamp", key: str = "transaction_id", target: str = "is_fraud") -> dict:
    """Counts and time ranges; an error for other schemas, empty splits, lost rows, bad targets, shared keys or mixed times."""
    if set(splits) != set(SPLITS):
        raise ValueError(f"expected the splits {SPLITS}")
    if any(s.schema.names != source.schema.names or [f.dataType for f in s.schema] != [f.dataType for f in source.schema] for s in splits.values()):
        raise ValueError("the splits' schemas must be the source's")
    found = split_findings(source, splits, time, key, target).first()
    stats = {n: {"split": n} | {k: found[f"{n}_{k}"] for k in ("row_count", "invalid_target_count", "min_timestamp", "max_timestamp")} for n in SPLITS}
    if empty := [n for n, s in stats.items() if not s["row_count"]]:
        raise ValueError(f"empty splits: {empty}")
    twice, total, wrong = found["duplicate_transaction_id_count"], found["total_row_count"], sum(s["invalid_target_count"] for s in stats.values())
    if sum(s["row_count"] for s in stats.values()) != total or wrong or twice:
        raise ValueError(f"invalid splits: {stats}, {total} source rows, {twice} duplicate keys")
    for a, b in zip(SPLITS, SPLITS[1:], strict=False):
        if stats[a]["max_timestamp"] > stats[b]["min_timestamp"]:
            raise ValueError(f"{a} reaches into {b}")
    return {"total_row_count": total, "invalid_target_count": wrong, "duplicate_transaction_id_count": twice, "splits": stats}
