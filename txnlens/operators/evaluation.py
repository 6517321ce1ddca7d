"""Scores against labels at any scale: every metric is an aggregate over (group, score) counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buckets import cut_points, place, same


#: How classes of unequal size are weighted in training.
IMBALANCE = ("none", "class_weights", "scale_pos_weight")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def check_scores(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """The frame, if labels are 0 or 1, both occur, and scores lie in [0, 1] and are finite."""
    bad = F.coalesce(~F.col(label).isin(0, 1), F.lit(True)) | F.col(score).isNull() | F.isnan(score) | (F.col(score) < 0) | (F.col(score) > 1)
    n, wrong, positives = df.agg(F.count(F.lit(1)), F.count_if(bad), F.count_if(F.col(label) == 1)).first()
    if not n or wrong or positives in (0, n):
        raise ValueError(f"{n} rows, {wrong} of them invalid, {positives} positive: scores need valid rows of both classes")
    return df


def confusion(df: DataFrame, threshold: float | Column, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Counts, rates, Brier score and alert rate at a threshold (a number or a column); a score at the threshold alerts."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    alert, y = F.col(score) >= t, F.col(label) == 1
    tp, fp, fn, tn = F.count_if(alert & y), F.count_if(alert & ~y), F.count_if(~alert & y), F.count_if(~alert & ~y)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), tn.alias("true_negatives"), fp.alias("false_positives"), fn.alias("false_negatives"), tp.alias("true_positives"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.avg((F.col(score) - F.col(label)) ** 2).alias("brier_score"), F.avg(alert.cast("double")).alias("alert_rate"),
    )


def _curve(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Per distinct score: rows, positives, and both summed over this and higher scores, plus the group's totals.

    A group's scores are cut into ranges; sums run within a range, and the ranges' totals give what lies above it.
    """
    (cuts,) = cut_points(df, [F.col(score)])
    g = df.groupBy(*by, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("tp"))
    g = g.withColumn("range", place(F.col("s"), cuts))
    keys = [*by, "range"]
    higher, whole = Window.partitionBy(*by).orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)  # a row a range
    sums = g.groupBy(*keys).agg(F.sum("n").alias("rn"), F.sum("tp").alias("rtp"))
    above = lambda c: F.coalesce(F.sum(c).over(higher), F.lit(0))
    ranges = sums.select(*keys, above("rn").alias("an"), above("rtp").alias("atp"), F.sum("rtp").over(whole).alias("pos"), F.sum("rn").over(whole).alias("tot"))
    down = Window.partitionBy(*keys).orderBy(F.col("s").desc())
    c = g.select(*keys, "n", "tp", F.sum("n").over(down).alias("cn"), F.sum("tp").over(down).alias("ctp"))
    joined = c.alias("c").join(ranges.alias("r"), same("c", "r", keys))
    return joined.select(*[F.col(f"c.`{k}`").alias(k) for k in by], "n", "tp", (F.col("cn") + F.col("an")).alias("cn"), (F.col("ctp") + F.col("atp")).alias("ctp"), "pos", "tot")


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",)) -> DataFrame:
    """ROC-AUC (ties count half) and PR-AUC as average precision, null if a class is missing.

    The rows are first summed by distinct score; a task orders the distinct scores of one range of one group.
    """
    c = _curve(df, label, score, by)
    neg = F.col("n") - F.col("tp")
    roc = F.try_divide(F.sum(neg * (F.col("ctp") - F.col("tp")) + neg * F.col("tp") / 2), F.max(F.col("pos") * (F.col("tot") - F.col("pos"))).cast("double"))
    pr = F.try_divide(F.sum(F.col("tp") * F.col("ctp") / F.col("cn")), F.max("pos").cast("double"))
    return c.groupBy(*by).agg(roc.alias("roc_auc"), pr.alias("pr_auc"))


def check_thresholds(thresholds: Sequence[float]) -> list[float]:
    out = [float(t) for t in thresholds]
    if not out or any(not 0 <= t <= 1 for t in out) or out != sorted(set(out)):
        raise ValueError("thresholds must be one or more, sorted, unique and between 0 and 1")
    return out


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], fp_cost: float = 1.0, fn_cost: float = 1.0, label: str = "label", score: str = "score", by: Sequence[str] = ("model",)) -> DataFrame:
    """Metrics and expected cost of each threshold, one row each, in one pass.

    Rows are summed by the number of thresholds that their score reaches (a row-local count), and those few sums are
    accumulated from above; rows are not multiplied by thresholds.
    """
    ts = check_thresholds(thresholds)
    if not (0 <= fp_cost < float("inf") and 0 <= fn_cost < float("inf")):
        raise ValueError("costs must be finite and not negative")
    reached = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in ts), F.lit(0))
    y = F.col(label) == 1
    sums = df.groupBy(*by, reached.alias("k")).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("q"), F.sum((F.col(score) - F.col(label)) ** 2).alias("se"))
    per = sums.groupBy(*by).agg(F.collect_list(F.struct("k", "p", "q")).alias("x"), F.sum("p").alias("pos"), F.sum("q").alias("neg"), F.sum("se").alias("se"))
    above = lambda f, i: F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + F.when(x["k"] > i, x[f]).otherwise(0))
    each = per.select(*by, "pos", "neg", "se", F.posexplode(F.array(*map(F.lit, ts))).alias("i", "threshold"), "x")
    each = each.withColumns({"tp": above("p", F.col("i")), "fp": above("q", F.col("i"))})
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("pos") - F.col("tp")
    n = F.col("pos") + F.col("neg")
    return each.select(
        *by, "threshold", n.alias("row_count"), (F.col("neg") - fp).alias("true_negatives"), fp.alias("false_positives"), fn.alias("false_negatives"), tp.alias("true_positives"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(F.col("se"), n).alias("brier_score"), _ratio(tp + fp, n).alias("alert_rate"), (fp * float(fp_cost) + fn * float(fn_cost)).alias("expected_cost"),
    )


def bin_edges(bins: int) -> list[float]:
    """Equal-width edges from 0 to 1, as multiples of the step in doubles; the last is 1."""
    if bins < 1:
        raise ValueError("at least one bin is needed")
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def calibration_bins(df: DataFrame, bins: int = 10, label: str = "label", score: str = "score", by: Sequence[str] = ("model",)) -> DataFrame:
    """[lo, hi) bins, the last closed; empty bins are kept with zeros."""
    edges = bin_edges(bins)
    place = sum((F.when(F.col(score) >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    sums = df.groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.avg(score).alias("m"), F.avg(F.col(label).cast("double")).alias("r"))
    per = sums.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("c", "m", "r")))).alias("x"))
    all_bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(edges[i]).alias("lower"), F.lit(edges[i + 1]).alias("upper")) for i in range(bins)])
    got = F.try_element_at("x", F.col("b.bin"))
    zero = lambda f, t: F.coalesce(got[f], F.lit(0).cast(t))
    return per.select(*by, "x", F.explode(all_bins).alias("b")).select(*by, "b.*", zero("c", "long").alias("row_count"), zero("m", "double").alias("mean_predicted_probability"), zero("r", "double").alias("observed_positive_rate"))


def calibration_error(bins: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Expected calibration error: the bins' absolute gaps, weighted by their rows."""
    gap = F.abs(F.col("mean_predicted_probability") - F.col("observed_positive_rate"))
    return bins.groupBy(*by).agg(_ratio(F.sum(F.col("row_count") * gap), F.sum("row_count")).alias("calibration_error"))


def class_weights(df: DataFrame, target: str = "label") -> DataFrame:
    """Counts, positive rate, balanced weights n / (2 n_c), and negatives a positive; one row. Null or other targets are an error."""
    if not df.filter(F.coalesce(~F.col(target).isin(0, 1), F.lit(True))).isEmpty():
        raise ValueError("targets must be 0 or 1")
    n, p = F.count(F.lit(1)), F.count_if(F.col(target) == 1)
    return df.agg(
        n.alias("row_count"), p.alias("positive_count"), (n - p).alias("negative_count"), _ratio(p, n).alias("positive_rate"),
        F.try_divide(n.cast("double"), 2.0 * (n - p)).alias("negative_weight"), F.try_divide(n.cast("double"), 2.0 * p).alias("positive_weight"), F.try_divide((n - p).cast("double"), p.cast("double")).alias("scale_pos_weight"),
    )


def best_threshold(sweep: DataFrame, strategy: str = "metric", metric: str = "f1", minimum_recall: float | None = None, by: Sequence[str] = ("model",)) -> DataFrame:
    """Each group's chosen row: highest metric then lowest cost, or lowest cost then highest recall; then the lowest threshold.

    Groups where no threshold has the minimum recall have no row.
    """
    if strategy not in ("metric", "business_cost"):
        raise ValueError("strategy must be 'metric' or 'business_cost'")
    if minimum_recall is not None and not 0 <= minimum_recall <= 1:
        raise ValueError("the minimum recall must be between 0 and 1")
    order = [-F.col(metric), F.col("expected_cost")] if strategy == "metric" else [F.col("expected_cost"), -F.col("recall")]
    rows = sweep if minimum_recall is None else sweep.filter(F.col("recall") >= minimum_recall)
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*order, F.col("threshold")])])
    rest = [c for c in sweep.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("x")).select(*by, "x.*")


def rank_candidates(chosen: DataFrame, metric: str = "pr_auc") -> DataFrame:
    """Candidates with their place: by metric downwards, then expected cost, then name. One row a model, so few rows."""
    return chosen.withColumn("place", F.row_number().over(Window.orderBy(F.col(metric).desc(), "expected_cost", "model")))


def rejected_candidates(sweep: DataFrame, minimum_recall: float) -> DataFrame:
    """Models none of whose thresholds has the minimum recall, with their highest recall and the threshold of that (for diagnosis)."""
    best = sweep.groupBy("model").agg(F.max("recall").alias("maximum_recall"), F.min_by("threshold", F.struct(-F.col("recall"), "expected_cost", "threshold")).alias("diagnostic_threshold"))
    return best.filter(F.col("maximum_recall") < minimum_recall)
