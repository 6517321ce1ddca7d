"""Registered queries of the engine's own operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import features as fx
from .functions import rules
from .operators import boosting, canonical, drift, evaluation, fingerprint, gates, logistic, metrics, ml, monitoring, profiling, ranks, sampling, split, summary, validation, windows
from .plans.contract import CATEGORICAL_FEATURES, MODEL_DATASET, MODEL_FEATURES, TARGET, passes
from .sources import testdata as td

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
RATIOS = (0.70, 0.15, 0.15)
THRESHOLDS = [i / 20 for i in range(1, 20)]
COSTS = {"fp_cost": 1.0, "fn_cost": 5.0}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonicalize(td.raw_transactions(spark, d))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders under the names that splits and samples use."""
    return td.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("transaction_id"), F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").alias("amount"), (F.col("o_orderstatus") == "F").cast("int").alias("is_fraud"))


def _rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Averages and sums of doubles depend on the order of rows in their last digits."""
    return df.withColumns({c: F.round(c, places) for c in names})


@query
def behavior_features(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(windows.add_behavior_features(td.event_transactions(spark, d)), "amount_sum_last_24h")


@query
def raw_transactions(spark: SparkSession, d: str) -> DataFrame:
    return td.raw_transactions(spark, d)


@query
def canonical_transactions(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d)


@query
def amount_features(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_canonical(spark, d).select("transaction_id", *[c.alias(k) for k, c in fx.amount_features().items()]), "amount_log", places=9)


@query
def balance_features(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).select("transaction_id", *[c.alias(k) for k, c in fx.balance_features().items()])


@query
def type_indicators(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).select("transaction_id", *[c.alias(k) for k, c in fx.type_indicators().items()])


@query
def calendar_features(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).select("transaction_id", *[c.alias(k) for k, c in fx.calendar_features().items()])


@query
def full_feature_row(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_rounded(canonical.build_features(_canonical(spark, d)), "amount_log", places=9), "amount_sum_last_24h")


@query
def model_dataset(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(canonical.model_dataset(_canonical(spark, d).withColumns(fx.row_features())), "amount_log", places=9)


@query
def raw_validation(spark: SparkSession, d: str) -> DataFrame:
    return validation.validate_raw(td.raw_transactions(spark, d))


@query
def canonical_validation(spark: SparkSession, d: str) -> DataFrame:
    return validation.validate_canonical(_canonical(spark, d))


@query
def domain_validation(spark: SparkSession, d: str) -> DataFrame:
    return validation.validate_domain(_canonical(spark, d))


def _violations(rule: str) -> Query:
    return lambda spark, d: validation.violations(_canonical(spark, d), rule).select("transaction_id", "transaction_type", "amount", *rules.BALANCES)


QUERIES["negative_balances"] = _violations("negative_balance")
QUERIES["origin_inconsistent"] = _violations("origin_inconsistent")
QUERIES["destination_inconsistent"] = _violations("destination_inconsistent")


@query
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    lines = td.table(spark, d, "lineitem", "l_orderkey", "l_linenumber").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"))
    return validation.duplicate_keys(lines)


@query
def invalid_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Events whose inverse distance to a whole value is not finite."""
    v = F.col("value") - F.floor("value")
    return validation.invalid_numbers(td.table(spark, d, "events", "event_id", "value").select("event_id", F.when(v == 0, F.lit(float("inf"))).otherwise(1 / F.when(v == 0, 1.0).otherwise(v)).alias("x"))).select("event_id")


@query
def consistency_by_type(spark: SparkSession, d: str) -> DataFrame:
    return profiling.consistency_by_type(_canonical(spark, d))


@query
def behavior_flags(spark: SparkSession, d: str) -> DataFrame:
    return profiling.behavior_flags(_canonical(spark, d)).select("transaction_id", "origin_delta", "destination_delta", "origin_expected_delta", "origin_exact_match", "origin_floor_match", "destination_plus_amount_match")


@query
def behavior_by_type(spark: SparkSession, d: str) -> DataFrame:
    return profiling.behavior_by_type(profiling.behavior_flags(_canonical(spark, d)))


@query
def split_exact(spark: SparkSession, d: str) -> DataFrame:
    return split.tagged(split.split_exact(_orders(spark, d), *RATIOS)).select("transaction_id", "split")


@query
def split_time_boundary(spark: SparkSession, d: str) -> DataFrame:
    return split.tagged(split.split_by_time(_orders(spark, d), *RATIOS, error=0.0)).select("transaction_id", "split")


@query
def split_stats(spark: SparkSession, d: str) -> DataFrame:
    return split.split_stats(split.split_exact(_orders(spark, d), *RATIOS))


@query
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Users that the events' splits share."""
    e = td.event_transactions(spark, d).withColumn("transaction_id", F.col("transaction_id").cast("string"))
    return split.overlaps(split.split_exact(e, *RATIOS), "origin_account_id")


@query
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    from .operators.dataset import split_summary as summary

    return summary(_orders(spark, d), time="timestamp")


@query
def split_validation(spark: SparkSession, d: str) -> DataFrame:
    """What the check of a split finds, with the split chosen by its configured strategy; one row."""
    df = _orders(spark, d)
    found = split.split_findings(df, split.chronological_split(df, *RATIOS))
    wrong = sum((F.col(f"{n}_invalid_target_count") for n in split.SPLITS), F.lit(0))
    return found.select("total_row_count", wrong.cast("long").alias("invalid_target_count"), "duplicate_transaction_id_count", *[f"{n}_row_count" for n in split.SPLITS])


@query
def sample_in_order(spark: SparkSession, d: str) -> DataFrame:
    """A seeded quarter of the orders, numbered in their order of time."""
    df = _orders(spark, d)
    return sampling.sample_in_order(df, df.count() // 4, 42, "timestamp", "transaction_id").select(F.col("row_index").cast("long").alias("row_index"), "transaction_id")


@query
def sample_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Each split's sample by its configured strategy."""
    df = _orders(spark, d)
    parts = split.split_exact(df, *RATIOS)
    ways = {"train": (df.count() // 2, "negative_sampling"), "validation": (df.count() // 20, "exact"), "test": (None, "full")}
    return split.tagged({n: sampling.sample_split(parts[n], n, "is_fraud", most, 42, way)[0] for n, (most, way) in ways.items()}).select("transaction_id", "split")


@query
def imbalance_weights(spark: SparkSession, d: str) -> DataFrame:
    """Rows and weight of each class under each policy that weights."""
    df = td.scores(spark, d)
    each = [ml.weighted(df, "label", p).groupBy("label").agg(F.count(F.lit(1)).alias("row_count"), F.max("weight").alias("weight")).select(F.lit(p).alias("policy"), "*") for p in evaluation.IMBALANCE[1:]]
    return _rounded(each[0].unionByName(each[1]), "weight")


@query
def sample_keep_positives(spark: SparkSession, d: str) -> DataFrame:
    df = _orders(spark, d)
    return sampling.keep_positives(df, "is_fraud", df.count() // 2, 42)[0].select("transaction_id", "is_fraud")


@query
def sample_exact(spark: SparkSession, d: str) -> DataFrame:
    df = _orders(spark, d)
    return sampling.cap_rows(df, "is_fraud", df.count() // 3, 42)[0].select("transaction_id")


@query
def sample_hash(spark: SparkSession, d: str) -> DataFrame:
    df = _orders(spark, d)
    return sampling.cap_rows(df, "is_fraud", df.count() // 3, 42, "hash")[0].select("transaction_id")


@query
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    s = sampling.summarize(_orders(spark, d), "is_fraud")
    return spark.range(1).select(F.lit(s.source_row_count).cast("long").alias("row_count"), F.lit(s.source_positive_count).cast("long").alias("positive_count"))


@query
def strided_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.strided(td.prediction_events(spark, d), 777, "event_time", "feedback_id").select("feedback_id")


@query
def kth_row(spark: SparkSession, d: str) -> DataFrame:
    """The middle order by date and key."""
    df = _orders(spark, d)
    t, k = ranks.kth_row(df, "timestamp", "transaction_id", df.count() // 2)
    return spark.range(1).select(F.lit(t).alias("timestamp"), F.lit(k).alias("transaction_id"))


@query
def confusion_at_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.confusion(td.scores(spark, d), 0.25, by=("model",)), "brier_score", "alert_rate", "precision", "recall", "f1")


@query
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.threshold_sweep(td.scores(spark, d), THRESHOLDS, **COSTS), "brier_score", "alert_rate", "precision", "recall", "f1")


@query
def roc_pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.ranking_metrics(td.scores(spark, d)), "roc_auc", "pr_auc", places=9)


@query
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.calibration_bins(td.scores(spark, d)), "lower", "upper", "mean_predicted_probability", "observed_positive_rate")


@query
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.calibration_error(evaluation.calibration_bins(td.scores(spark, d))), "calibration_error")


@query
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.class_weights(td.scores(spark, d)), "positive_rate", "negative_weight", "positive_weight", "scale_pos_weight")


def _best(spark: SparkSession, d: str, **policy) -> DataFrame:
    sweep = evaluation.threshold_sweep(td.scores(spark, d), THRESHOLDS, **COSTS)
    return evaluation.best_threshold(sweep, **policy)


@query
def best_threshold_metric(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, minimum_recall=0.3).select("model", "threshold", "expected_cost")


@query
def best_threshold_cost(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, strategy="business_cost").select("model", "threshold", "expected_cost")


@query
def candidate_ranking(spark: SparkSession, d: str) -> DataFrame:
    joined = _best(spark, d, minimum_recall=0.3).join(evaluation.ranking_metrics(td.scores(spark, d)), "model")
    return evaluation.rank_candidates(joined).select("model", "threshold", "place")


@query
def rejected_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.rejected_candidates(evaluation.threshold_sweep(td.scores(spark, d), THRESHOLDS[8:], **COSTS), 0.5), "maximum_recall")


def _window(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return td.prediction_events(spark, d), td.delayed_labels(spark, d)


@query
def labels_joined(spark: SparkSession, d: str) -> DataFrame:
    """-1 stands for no label yet."""
    return monitoring.labelled_events(*_window(spark, d)).select("feedback_id", "event_time", F.coalesce("label", F.lit(-1)).alias("label"), "label_time")


@query
def labels_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.unmatched_labels(*_window(spark, d))


@query
def labels_overdue(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.overdue_events(*_window(spark, d), td.AS_OF, 7).select("feedback_id", "event_time")


@query
def label_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.settle_labels(td.label_submissions(spark, d))


@query
def monitoring_counters(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.snapshot(*_window(spark, d), td.AS_OF, 14, 21, 7, 500)[1]


@query
def latest_events(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.latest(td.prediction_events(spark, d), 500).select("feedback_id", "event_time")


@query
def retained_events(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.retain(td.prediction_events(spark, d), "event_time", td.AS_OF, 14).select("feedback_id")


@query
def segment_summary(spark: SparkSession, d: str) -> DataFrame:
    reference = {"model_name": "risk", "model_version": "v1", "feature_contract_version": "pre-transaction-v1"}
    return monitoring.segments(monitoring.labelled_events(*_window(spark, d)), reference)


@query
def segment_drift(spark: SparkSession, d: str) -> DataFrame:
    """Every segment's drift against the reference rows of two models in turn; one of them has features that can't be reported."""
    reference, current = td.segment_rows(spark, d)
    edges = {"amount": [10.0, 25.0, 50.0, 100.0, 200.0], "hour": [6.0, 12.0, 18.0], "risk_score": [0.1, 0.2, 0.4]}
    each = []
    for name, version in (("risk", "v1"), ("risk model", "v0")):
        of = {"model_name": name, "model_version": version, "feature_contract_version": "pre-transaction-v1"}
        each.append(monitoring.segment_drift(current.withColumn("label", F.lit(None).cast("int")), reference.filter((F.col("model_name") == name) & (F.col("model_version") == version)), of, list(edges), edges).select(F.lit(name).alias("reference_model"), "*"))
    text = {c: F.coalesce(c, F.lit("")) for c in ("drift_error_stage", "drift_error")}
    return _rounded(each[0].unionByName(each[1]), "psi").withColumns({**text, "psi": F.coalesce("psi", F.lit(-1.0))})


@query
def segment_performance(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(monitoring.segment_performance(monitoring.labelled_events(*_window(spark, d))), "precision", "recall", "f1", "roc_auc", "pr_auc", "brier_score", "alert_rate")


@query
def decisions(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.decide(td.prediction_events(spark, d), 0.25).select("feedback_id", "decision")


@query
def event_contract(spark: SparkSession, d: str) -> DataFrame:
    """The rules that each event breaks."""
    return monitoring.event_errors(td.contract_events(spark, d), ("amount", "transaction_type")).select("event_id", F.array_join("errors", ",").alias("errors"))


@query
def label_contract(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.label_errors(td.contract_labels(spark, d), td.AS_OF).select("feedback_id", "label_time", F.array_join("errors", ",").alias("errors"))


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = td.table(spark, d, "events", "ts", "value", "user_id")
    return e.filter("ts < '2024-01-16'"), e.filter("ts >= '2024-01-16'")


@query
def psi_drift(spark: SparkSession, d: str) -> DataFrame:
    edges = {"value": [10.0, 25.0, 50.0, 100.0, 200.0], "user_id": [5.0, 50.0, 500.0]}
    return _rounded(drift.psi(*_halves(spark, d), ["value", "user_id"], edges), "psi")


@query
def ks_drift(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(drift.ks(*_halves(spark, d), ["value", "user_id"]), "ks")


@query
def categorical_drift(spark: SparkSession, d: str) -> DataFrame:
    e = td.table(spark, d, "events", "ts", "event_type", "user_id")
    return _rounded(drift.chi_square(e.filter("ts < '2024-01-16'"), e.filter("ts >= '2024-01-16'"), ["event_type", "user_id"]), "chi_square")


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    """The summary of two years of days, of the contract's features and the amount's share of a million."""
    rows = _canonical(spark, d).withColumns(fx.row_features()).withColumn("risk_score", F.least(F.col("amount") / 1e6, F.lit(1.0)))
    numeric = [*[c for c in MODEL_FEATURES if c not in CATEGORICAL_FEATURES], "risk_score"]
    return summary.merge_summaries(summary.daily_summary(rows, "timestamp", numeric, CATEGORICAL_FEATURES), date(2030, 1, 1), date(2031, 12, 31))


@query
def data_summary(spark: SparkSession, d: str) -> DataFrame:
    """What is exact in the summaries: days, counts, nulls, range, mean and deviation."""
    return _rounded(_summaries(spark, d).drop("distinct_estimate", "quantiles"), "minimum", "maximum", "mean", "deviation", places=5)


@query
def data_summary_sketches(spark: SparkSession, d: str) -> DataFrame:
    """What is estimated in them: distinct values and quantiles."""
    return _summaries(spark, d).select("feature", "distinct_estimate", "quantiles")


@query
def logistic_newton(spark: SparkSession, d: str) -> DataFrame:
    """Each model's scores calibrated by a logistic curve, six Newton steps: its two numbers and the likelihood before the last step."""
    rows = td.scores(spark, d)
    fits = {m: logistic.fit(rows.filter(F.col("model") == m), ["score"], "label", steps=6) for m in ("alpha", "beta")}
    return spark.createDataFrame([(m, round(f.intercept, 6), round(f.coefficients[0], 6), round(f.log_likelihood, 3)) for m, f in fits.items()], "model string, intercept double, coefficient double, log_likelihood double")


@query
def calibrated_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every event's chance by the curve that is fitted to alpha's scores."""
    alpha = td.scores(spark, d).filter("model = 'alpha'")
    fitted = logistic.fit(alpha, ["score"], "label", steps=6)
    return fitted.score(alpha, "chance").groupBy(F.round("chance", 6).alias("chance"), "label").agg(F.count(F.lit(1)).alias("row_count"))


@query
def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Content of two tables, whatever their files."""
    parts = {"orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "events": ("event_id", "user_id", "event_type")}
    each = [fingerprint.content(td.table(spark, d, t, *cols)).select(F.lit(t).alias("name"), "*") for t, cols in parts.items()]
    return each[0].unionByName(each[1])


@query
def segment_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Calibration bins of every segment whose labels have both classes."""
    return _rounded(monitoring.segment_calibration(monitoring.labelled_events(*_window(spark, d))), "lower", "upper", "mean_predicted_probability", "observed_positive_rate")


@query
def quality_gate_checks(spark: SparkSession, d: str) -> DataFrame:
    """Beta as the candidate against alpha as the incumbent, on the validation and test splits of the events; keys, overlaps and contract are measured."""
    e = td.table(spark, d, "events", "event_id", "ts", "value").withColumns({"transaction_id": F.col("event_id").cast("string"), "timestamp": F.col("ts")})
    parts = split.split_exact(e, *RATIOS)
    rows = split.tagged({n: td.scores_of(parts[n]) for n in ("validation", "test")}).select(F.concat_ws("_", "split", "model").alias("model"), "label", "score")
    sweep = evaluation.threshold_sweep(rows, [0.25], **COSTS)
    m = sweep.join(evaluation.ranking_metrics(rows), "model").join(evaluation.calibration_error(evaluation.calibration_bins(rows)), "model")
    m = m.withColumn("expected_cost_per_transaction", F.col("expected_cost") / F.col("row_count")).withColumn("positive_count", F.col("true_positives") + F.col("false_negatives"))
    names = ("pr_auc", "precision", "recall", "expected_cost_per_transaction", "brier_score", "calibration_error", "alert_rate", "row_count", "positive_count")
    said = {"validation_beta": "validation", "test_beta": "test", "test_alpha": "incumbent"}
    facts = m.select("model", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("x")) for n in names])).alias("y")).select("model", "y.*")
    twice = validation.duplicate_keys(e).agg(F.count(F.lit(1)).cast("double").alias("x")).select(F.lit("data").alias("model"), F.lit("duplicate_transaction_id_count").alias("name"), "x")
    shared = split.overlaps(parts).agg(F.sum("overlap_count").cast("double").alias("x")).select(F.lit("data").alias("model"), F.lit("split_overlap_count").alias("name"), "x")
    fact = lambda who, n: F.max(F.when((F.col("model") == who) & (F.col("name") == n), F.col("x")))
    measured = facts.unionByName(twice).unionByName(shared).agg(*[fact(who, n).alias(f"{to}_{n}") for who, to in said.items() for n in names], *[fact("data", n).alias(n) for n in ("duplicate_transaction_id_count", "split_overlap_count")])
    contract = passes(c for c in _model_rows(spark, d).columns if c not in ("transaction_id", TARGET))
    return _rounded(gates.quality_gate(measured.select(F.lit("beta").alias("model"), F.lit(contract).alias("schema_contract_passed"), "*")), "actual")


@query
def rate_5m(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.event_rate(td.table(spark, d, "events", "ts", "event_type"), ("event_type",)), "rate")


@query
def rate_5m_sliding(spark: SparkSession, d: str) -> DataFrame:
    """The rate over five minutes at every minute."""
    return _rounded(metrics.event_rate(td.table(spark, d, "events", "ts", "event_type"), ("event_type",), step="1 minute"), "rate")


@query
def error_ratio_sliding(spark: SparkSession, d: str) -> DataFrame:
    """The ratio over an hour at every quarter of an hour."""
    return _rounded(metrics.error_ratio(td.table(spark, d, "events", "ts", "event_type"), F.col("event_type") == "error", "1 hour", step="15 minutes"), "ratio")


@query
def error_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.error_ratio(td.table(spark, d, "events", "ts", "event_type"), F.col("event_type") == "error", "1 hour"), "ratio")


@query
def histogram_p95(spark: SparkSession, d: str) -> DataFrame:
    e = td.table(spark, d, "events", "ts", "value").withColumn("latency", F.col("value") / 100.0)
    return _rounded(metrics.histogram_quantile(e, "latency", 0.95, window="1 hour"), "quantile")


@query
def counter_increase(spark: SparkSession, d: str) -> DataFrame:
    """Each user's event ids as a counter that resets at every thousand."""
    samples = td.table(spark, d, "events", "event_id", "ts", "user_id").select("ts", "user_id", (F.col("event_id") % 1000).cast("double").alias("value"))
    return _rounded(metrics.counter_rate(samples, ("user_id",), "1 day"), "rate").select("window_start", "user_id", "increase", "rate")


@query
def rate_extrapolated(spark: SparkSession, d: str) -> DataFrame:
    """The same counters' rate of a day at every six hours, from the day's own samples."""
    samples = td.table(spark, d, "events", "event_id", "ts", "user_id").select("ts", "user_id", (F.col("event_id") % 1000).cast("double").alias("value"))
    return _rounded(metrics.extrapolated_rate(samples, ("user_id",), "1 day", step="6 hours"), "increase", "rate")


@query
def alert_states(spark: SparkSession, d: str) -> DataFrame:
    """The error ratio's alert, with half an hour to hold, at every quarter of an hour."""
    ratio = metrics.error_ratio(td.table(spark, d, "events", "ts", "event_type"), F.col("event_type") == "error", "1 hour", step="15 minutes", limit=0.2)
    return metrics.alert_states(ratio, "30 minutes", "15 minutes").select("window_start", "firing", F.coalesce("active_since", F.lit(datetime(1970, 1, 1))).alias("active_since"), "state")


def _model_rows(spark: SparkSession, d: str) -> DataFrame:
    return canonical.model_dataset(_canonical(spark, d).withColumns(fx.row_features()))


@query
def preprocessed_features(spark: SparkSession, d: str) -> DataFrame:
    """Events with missing values through the models' preprocessing: median, standard scores, mode, one column a category."""
    e = td.table(spark, d, "events", "event_id", "value", "user_id", "event_type")
    rows = e.select("event_id", F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("value"), "user_id", F.when(F.col("event_id") % 17 != 0, F.col("event_type")).alias("event_type"))
    columns = ("value", "user_id", "event_type")
    filled = ml.as_doubles(rows, columns)
    x = vector_to_array("features")
    out = Pipeline(stages=ml.preprocessing(filled, columns, median_error=0.0)).fit(filled).transform(filled).select("event_id", x.alias("x"))
    return _rounded(out.select("event_id", F.col("x")[0].alias("value"), F.col("x")[1].alias("user_id"), F.array_position(F.slice("x", 3, F.size("x") - 2), 1.0).alias("category")), "value", "user_id")


def _scored(name: str, **params) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _model_rows(spark, d)
        kept = rows.persist()
        try:
            model = ml.train(kept, name, **params)
        finally:
            kept.unpersist()
        return ml.score(model, rows).select("transaction_id", F.round("risk_score", 6).alias("risk_score"))

    return run


QUERIES["logistic_regression_scores"] = _scored("logistic_regression")
QUERIES["random_forest_scores"] = _scored("random_forest", trees=10, depth=5)
QUERIES["gradient_boosting_scores"] = _scored("gradient_boosting", trees=5, depth=3)

@query
def boosted_scores(spark: SparkSession, d: str) -> DataFrame:
    """Second-order boosting, ten trees of depth six, on the contract's numeric features."""
    rows = _model_rows(spark, d)
    model = boosting.fit(rows, [c for c in MODEL_FEATURES if c not in CATEGORICAL_FEATURES], TARGET, trees=10)
    return model.score(rows).select("transaction_id", F.round("risk_score", 6).alias("risk_score"))


assert set(MODEL_FEATURES) < set(MODEL_DATASET)
