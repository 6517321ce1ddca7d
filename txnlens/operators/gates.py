"""Promotion gates: one row a check, from one row of measurements a candidate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GatePolicy:
    # The default policy.
    absolute: dict[str, float] = field(
        default_factory=lambda: {
            "minimum_validation_pr_auc": 0.50, "minimum_validation_precision": 0.50, "minimum_validation_recall": 0.80,
            "minimum_test_pr_auc": 0.50, "minimum_test_precision": 0.50, "minimum_test_recall": 0.80,
            "maximum_test_expected_cost_per_transaction": 0.10, "maximum_test_brier_score": 0.10, "maximum_test_calibration_error": 0.10, "maximum_test_alert_rate": 0.05,
        }
    )
    minimum_test_rows: int = 10_000
    minimum_test_positives: int = 100
    comparison: dict[str, float] = field(
        default_factory=lambda: {
            "minimum_pr_auc_delta": -0.01, "minimum_precision_delta": -0.05, "minimum_recall_delta": -0.02, "maximum_expected_cost_per_transaction_increase": 0.01,
            "maximum_brier_score_increase": 0.01, "maximum_calibration_error_increase": 0.02, "maximum_alert_rate_increase": 0.02,
        }
    )


def checks(policy: GatePolicy = GatePolicy()) -> list[tuple[str, str, str, float]]:
    """(name, expression over the measurements, operator, threshold) of the 22 checks."""
    a, c = policy.absolute, policy.comparison
    out = [("schema.feature_contract", "cast(schema_contract_passed as double)", "==", 1.0), ("leakage.duplicate_transaction_ids", "duplicate_transaction_id_count", "==", 0.0), ("leakage.split_overlap", "split_overlap_count", "==", 0.0)]
    out += [(f"validation.{m}", f"validation_{m}", ">=", a[f"minimum_validation_{m}"]) for m in ("pr_auc", "precision", "recall")]
    out += [("test.rows", "test_row_count", ">=", float(policy.minimum_test_rows)), ("test.positives", "test_positive_count", ">=", float(policy.minimum_test_positives))]
    out += [(f"test.{m}", f"test_{m}", ">=", a[f"minimum_test_{m}"]) for m in ("pr_auc", "precision", "recall")]
    falls = ("expected_cost_per_transaction", "brier_score", "calibration_error", "alert_rate")
    out += [(f"test.{m}", f"test_{m}", "<=", a[f"maximum_test_{m}"]) for m in falls]
    out += [(f"comparison.{m}", f"test_{m} - incumbent_{m}", ">=", c[f"minimum_{m}_delta"]) for m in ("pr_auc", "precision", "recall")]
    out += [(f"comparison.{m}_increase", f"test_{m} - incumbent_{m}", "<=", c[f"maximum_{m}_increase"]) for m in falls]
    return out


def quality_gate(measured: DataFrame, policy: GatePolicy = GatePolicy(), by: tuple[str, ...] = ("model",)) -> DataFrame:
    """(by, name, actual, operator, threshold, passed) of every check; a null measurement doesn't pass."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.expr(e).cast("double").alias("actual"), F.lit(op).alias("operator"), F.lit(t).alias("threshold")) for n, e, op, t in checks(policy)])
    each = measured.select(*by, F.explode(rows).alias("x")).select(*by, "x.*")
    passed = F.when(F.col("operator") == ">=", F.col("actual") >= F.col("threshold")).when(F.col("operator") == "<=", F.col("actual") <= F.col("threshold")).otherwise(F.col("actual") == F.col("threshold"))
    return each.withColumn("passed", F.coalesce(passed & ~F.isnan("actual"), F.lit(False)))


def gate_status(rows: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """``passed`` or ``rejected``, and the failed checks' names, of each candidate."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name"))))
    return rows.groupBy(*by).agg(F.when(F.every("passed"), "passed").otherwise("rejected").alias("status"), failed.alias("failed_checks"))
