"""Models as pyspark.ml pipelines: imputation, scaling, one-hot encoding, and three classifiers with an imbalance policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..plans.contract import MODEL_FEATURES, TARGET
from .evaluation import IMBALANCE, class_weights

MODELS = ("logistic_regression", "random_forest", "gradient_boosting")


def column_kinds(df: DataFrame, columns: Sequence[str] = MODEL_FEATURES) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns, in order."""
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, NumericType)]
    return numeric, [c for c in columns if c not in numeric]


def preprocessing(df: DataFrame, columns: Sequence[str] = MODEL_FEATURES, median_error: float = 0.001) -> list:
    """Stages from columns to ``features``: medians (to a relative error of rank) and standard scores; the mode's index and one column a known category.

    An unknown category gets zeros: the indexer keeps it as an extra last index, which the encoder drops.
    """
    numeric, categorical = column_kinds(df, columns)
    stages: list = []
    if numeric:
        stages += [Imputer(strategy="median", relativeError=median_error, inputCols=numeric, outputCols=[f"{c}__filled" for c in numeric]), VectorAssembler(inputCols=[f"{c}__filled" for c in numeric], outputCol="numeric__raw"), StandardScaler(inputCol="numeric__raw", outputCol="numeric__scaled", withMean=True)]
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"{c}__index" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__index" for c in categorical], outputCols=[f"{c}__hot" for c in categorical], dropLast=True)]
    return [*stages, VectorAssembler(inputCols=(["numeric__scaled"] if numeric else []) + [f"{c}__hot" for c in categorical], outputCol="features")]


def as_doubles(df: DataFrame, columns: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """Numeric columns as doubles, and missing categories as the most frequent one."""
    numeric, categorical = column_kinds(df, columns)
    out = df.withColumns({c: F.col(c).cast("double") for c in numeric})
    for c in categorical:
        mode = df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.col("count").desc(), c).first()
        if mode:
            out = out.fillna({c: mode[0]})
    return out


def classifier(name: str, seed: int = 42, weight: str | None = "weight", **params):
    """One of MODELS; ``weight`` is the imbalance policy's column, None for none."""
    common = {"featuresCol": "features", "labelCol": "target"} | ({"weightCol": weight} if weight else {})
    if name == "logistic_regression":
        return LogisticRegression(**common, maxIter=params.pop("max_iter", 100), regParam=params.pop("reg", 0.0), **params)
    if name == "random_forest":
        return RandomForestClassifier(**common, seed=seed, numTrees=params.pop("trees", 200), maxDepth=params.pop("depth", 12), **params)
    if name == "gradient_boosting":
        return GBTClassifier(**common, seed=seed, maxIter=params.pop("trees", 200), maxDepth=params.pop("depth", 6), stepSize=params.pop("rate", 0.1), **params)
    raise ValueError(f"unknown model {name}; one of {MODELS}")


def weighted(df: DataFrame, target: str = TARGET, imbalance: str = "class_weights") -> DataFrame:
    """``weight`` of each row: n / (2 n_c) of its class, or, as ``scale_pos_weight``, negatives a positive for positives and 1 for negatives."""
    if imbalance not in IMBALANCE[1:]:
        raise ValueError(f"unknown imbalance policy {imbalance}; one of {IMBALANCE}")
    row = class_weights(df, target).first()
    positive, negative = (row["positive_weight"], row["negative_weight"]) if imbalance == "class_weights" else (row["scale_pos_weight"], 1.0)
    return df.withColumn("weight", F.when(F.col(target) == 1, F.lit(positive)).otherwise(F.lit(negative)))


def train(df: DataFrame, name: str, columns: Sequence[str] = MODEL_FEATURES, target: str = TARGET, imbalance: str = "class_weights", seed: int = 42, **params) -> PipelineModel:
    rows = as_doubles(df if imbalance == "none" else weighted(df, target, imbalance), columns).withColumn("target", F.col(target).cast("double"))
    return Pipeline(stages=[*preprocessing(rows, columns), classifier(name, seed, None if imbalance == "none" else "weight", **params)]).fit(rows)


def score(model: PipelineModel, df: DataFrame, columns: Sequence[str] = MODEL_FEATURES, output: str = "risk_score") -> DataFrame:
    """``df`` with the probability of the class 1."""
    kept = df.columns
    return model.transform(as_doubles(df, columns)).select(*[c for c in kept if c != output], vector_to_array("probability")[1].alias(output))


def predictions(models: dict[str, PipelineModel], df: DataFrame, target: str = TARGET, columns: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """(model, label, score) rows of every model, ready for the evaluation operators."""
    out = None
    for name, model in models.items():
        rows = score(model, df, columns).select(F.lit(name).alias("model"), F.col(target).alias("label"), F.col("risk_score").alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out
