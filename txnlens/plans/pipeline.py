"""The batch pipelines: raw file to checked splits, and splits to a chosen, gated model."""

from __future__ import annotations

from dataclasses import asdict

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canonical, evaluation, gates, ml, profiling, sampling, split, validation
from ..operators.dataset import Dataset, load_splits
from ..schemas import FEATURES, require_schema
from ..sources import readers, sinks
from ..sources.config import DataConfig, ModelConfig
from .contract import TARGET, passes


def run_etl(spark: SparkSession, config: DataConfig) -> dict:
    """Validate before anything is written, then write each layer and build on what was written, so nothing is computed twice."""
    out = config.output_folder.rstrip("/")
    raw = readers.read_raw_csv(spark, config.raw_path)
    if config.persist:
        raw = raw.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        raw_result = validation.require_valid(validation.validate_raw(raw))
        rows = canonical.canonicalize(raw, config.base_time)
        checked = validation.require_valid(validation.validate_canonical(rows), allowed=("null_balance_count",))
        domain = validation.require_valid(validation.validate_domain(rows), allowed=("origin_balance_mismatch_count", "destination_balance_mismatch_count"))
        sinks.write_parquet(rows, f"{out}/canonical", config.output_files)
    finally:
        raw.unpersist()
    rows = spark.read.parquet(f"{out}/canonical")
    profile = [r.asDict() for r in profiling.behavior_by_type(profiling.behavior_flags(rows)).collect()]
    sinks.write_parquet(require_schema(canonical.build_features(rows), FEATURES), f"{out}/features", config.output_files)
    features = spark.read.parquet(f"{out}/features")
    validation.require_numbers(features)
    splits = split.chronological_split(features, config.train_ratio, config.validation_ratio, config.test_ratio, config.split_strategy, config.quantile_error)
    result = split.validate_splits(features, splits)
    for name, df in splits.items():
        sinks.write_parquet(canonical.model_dataset(df), f"{out}/{name}", config.output_files)
    ranges = {n: {k: str(s[k]) for k in ("min_timestamp", "max_timestamp")} for n, s in result["splits"].items()}
    sinks.write_json({"splits": ranges, "ratios": {"train": config.train_ratio, "validation": config.validation_ratio, "test": config.test_ratio}, "strategy": config.split_strategy}, f"{out}/lineage.json")
    summary = {"raw": raw_result, "canonical": checked, "domain": domain, "profile": profile, "splits": {n: s["row_count"] for n, s in result["splits"].items()}}
    sinks.write_json(summary, f"{out}/summary.json")
    return summary


def evaluate_models(predictions: DataFrame, config: ModelConfig) -> tuple[DataFrame, DataFrame]:
    """The sweep of every model, and each eligible model's chosen threshold with its ranking metrics and place."""
    sweep = evaluation.threshold_sweep(predictions, config.thresholds, config.false_positive_cost, config.false_negative_cost)
    chosen = evaluation.best_threshold(sweep, config.threshold_strategy, config.threshold_metric, config.minimum_recall)
    return sweep, evaluation.rank_candidates(chosen.join(evaluation.ranking_metrics(predictions), "model"), config.primary_metric)


def measure(validated: DataFrame, tested: DataFrame, dataset: Dataset, incumbent: dict[str, float], calibration: float, target: str = TARGET) -> DataFrame:
    """One row of everything the gate looks at."""
    v = validated.select(*[F.col(m).alias(f"validation_{m}") for m in ("pr_auc", "precision", "recall")])
    t = tested.select("model", F.col("row_count").alias("test_row_count"), (F.col("true_positives") + F.col("false_negatives")).alias("test_positive_count"), *[F.col(m).alias(f"test_{m}") for m in ("pr_auc", "precision", "recall", "expected_cost_per_transaction", "brier_score", "alert_rate")])
    fixed = {f"incumbent_{k}": x for k, x in incumbent.items()} | {"test_calibration_error": calibration, "duplicate_transaction_id_count": float(sum(dataset.duplicates.values())), "split_overlap_count": float(sum(dataset.overlaps.values()))}
    row = v.first().asDict() | fixed
    contract = all(passes(c for c in df.columns if c not in ("transaction_id", target)) for df in dataset.splits.values())
    return t.withColumns({k: F.lit(float(x)) for k, x in row.items()}).withColumn("schema_contract_passed", F.lit(contract))


def run_training(spark: SparkSession, folder: str, config: ModelConfig, incumbent: dict[str, float] | None = None, **params) -> dict:
    """Train every model on the train split, choose on validation, and test the choice once at its frozen threshold."""
    data = load_splits(spark, folder, target=config.target)
    frames, summaries = {}, {}
    for name, df in data.splits.items():
        limit, strategy = (config.max_train_rows, config.train_strategy) if name == "train" else (config.max_evaluation_rows, config.evaluation_strategy)
        frames[name], summaries[name] = sampling.sample_split(df, name, config.target, limit, config.seed, strategy)
    models = {m: ml.train(frames["train"], m, target=config.target, imbalance=config.imbalance, seed=config.seed, **params.get(m, {})) for m in config.models}
    predicted = evaluation.check_scores(ml.predictions(models, frames["validation"], config.target)).persist()
    sweep, ranked = evaluate_models(predicted, config)
    best = ranked.filter("place = 1").first()
    if best is None:
        details = [r.asDict() for r in evaluation.rejected_candidates(sweep, config.minimum_recall or 0.0).collect()]
        raise ValueError(f"no model has a threshold with the minimum recall: {details}")
    name = best["model"]
    test = ml.predictions({name: models[name]}, frames["test"], config.target).persist()
    at = evaluation.confusion(test, best["threshold"], by=("model",)).join(evaluation.ranking_metrics(test), "model")
    cost = F.col("false_positives") * config.false_positive_cost + F.col("false_negatives") * config.false_negative_cost
    tested = at.withColumn("expected_cost", cost).withColumn("expected_cost_per_transaction", cost / F.col("row_count"))
    error = evaluation.calibration_error(evaluation.calibration_bins(test)).first()["calibration_error"]
    out = {"model": name, "threshold": best["threshold"], "validation": best.asDict(), "test": tested.first().asDict() | {"calibration_error": error}, "sampling": {k: asdict(s) for k, s in summaries.items()}, "models": models}
    if incumbent is not None:
        rows = gates.quality_gate(measure(ranked.filter("place = 1"), tested, data, incumbent, error, config.target))
        out["gate"] = gates.gate_status(rows).first().asDict()
    predicted.unpersist()
    test.unpersist()
    return out


def model_card(result: dict, target: str = TARGET) -> dict:
    """What is worth writing down of a training run."""
    return {"target": target, **{k: v for k, v in result.items() if k != "models"}}
