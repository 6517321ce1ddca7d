"""YAML settings, validated into dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any, TypeVar

from ..operators.evaluation import IMBALANCE
from ..operators.gates import GatePolicy
from ..operators.split import check_ratios
from ..session import SparkSettings

T = TypeVar("T")


@dataclass(frozen=True)
class DataConfig:
    raw_path: str
    output_folder: str
    base_time: str = "2026-01-01 00:00:00"
    train_ratio: float = 0.70
    validation_ratio: float = 0.15
    test_ratio: float = 0.15
    split_strategy: str = "exact"
    quantile_error: float = 0.01
    output_files: int = 8
    persist: bool = False
    spark: SparkSettings = field(default_factory=SparkSettings)

    def __post_init__(self) -> None:
        check_ratios(self.train_ratio, self.validation_ratio, self.test_ratio)
        if self.split_strategy not in ("exact", "time_boundary"):
            raise ValueError("split_strategy must be 'exact' or 'time_boundary'")
        if self.output_files < 1:
            raise ValueError("output_files must be at least 1")


@dataclass(frozen=True)
class ModelConfig:
    target: str = "is_fraud"
    seed: int = 42
    models: tuple[str, ...] = ("logistic_regression", "random_forest", "gradient_boosting")
    imbalance: str = "none"
    train_strategy: str = "negative_sampling"
    evaluation_strategy: str = "full"
    max_train_rows: int | None = 500_000
    max_evaluation_rows: int | None = None
    thresholds: tuple[float, ...] = tuple(i / 20 for i in range(1, 20))
    primary_metric: str = "pr_auc"
    threshold_strategy: str = "metric"
    threshold_metric: str = "f1"
    minimum_recall: float | None = 0.8
    false_positive_cost: float = 1.0
    false_negative_cost: float = 5.0

    def __post_init__(self) -> None:
        if not self.models:
            raise ValueError("at least one model is needed")
        if self.imbalance not in IMBALANCE:
            raise ValueError(f"imbalance must be one of {IMBALANCE}")
        if self.train_strategy == "negative_sampling" and self.imbalance != "none":
            raise ValueError(f"negative_sampling already changes the classes' shares; {self.imbalance} would weight them twice")
        if self.threshold_strategy not in ("metric", "business_cost"):
            raise ValueError("threshold_strategy must be 'metric' or 'business_cost'")


@dataclass(frozen=True)
class TrackingConfig:
    """Where runs and models are kept: a folder that Spark writes, an experiment in it, the name of the registered model."""

    uri: str
    experiment_name: str
    registered_model_name: str
    artifact_location: str | None = None

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if not (value is None and f.name == "artifact_location") and not (isinstance(value, str) and value.strip()):
                raise ValueError(f"{f.name} must be a text that is not empty")
            object.__setattr__(self, f.name, value.strip() if value else value)


def _build(kind: type[T], values: dict[str, Any]) -> T:
    known = {f.name for f in fields(kind)}  # type: ignore[arg-type]
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown settings for {kind.__name__}: {unknown}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def _read(path: str) -> dict[str, Any]:
    import yaml

    with open(path) as f:
        value = yaml.safe_load(f)
    if not isinstance(value, dict):
        raise ValueError(f"{path} must hold a mapping")
    return value


def data_config(path: str) -> DataConfig:
    values = _read(path)
    spark = _build(SparkSettings, values.pop("spark", {}) or {})
    return _build(DataConfig, values | {"spark": spark})


def model_config(path: str) -> ModelConfig:
    return _build(ModelConfig, _read(path))


def tracking_config(path: str, uri: str | None = None) -> TrackingConfig:
    """The mapping ``tracking`` of a file; ``uri`` replaces the file's."""
    values = _read(path).get("tracking")
    if not isinstance(values, dict):
        raise ValueError(f"{path} must hold a mapping named tracking")
    return _build(TrackingConfig, values | ({} if uri is None else {"uri": uri}))


def gate_policy(path: str) -> GatePolicy:
    policy = _build(GatePolicy, _read(path))
    default = GatePolicy()
    for part in ("absolute", "comparison"):
        if set(getattr(policy, part)) != set(getattr(default, part)):
            raise ValueError(f"{part} must have exactly {sorted(getattr(default, part))}")
    return policy
