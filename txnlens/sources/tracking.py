"""A store of training runs: parameters, metrics and tags as rows, one folder a run, under an experiment's folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import run_metadata
from .config import TrackingConfig


class Runs:
    """The runs of the configured experiment. A run is written once; a second one of its name is an error."""

    def __init__(self, spark: SparkSession, config: TrackingConfig) -> None:
        self.spark = spark
        self.folder = f"{config.uri.rstrip('/')}/{config.experiment_name}"

    def log(self, run: str, params: dict, metrics: dict[str, float], tags: dict[str, str] | None = None) -> None:
        rows = run_metadata(self.spark, run, params, metrics)
        if tags:
            rows = rows.unionByName(self.spark.createDataFrame([(run, "tag", k, str(v)) for k, v in sorted(tags.items())], rows.schema))
        try:
            rows.drop("run").coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/run={run}")
        except AnalysisException as e:
            raise ValueError(f"the run {run} is there already") from e

    def read(self) -> DataFrame:
        """(kind, name, value, run) of all runs."""
        return self.spark.read.option("basePath", self.folder).schema("kind string, name string, value string, run string").parquet(self.folder)

    def ranked(self, metric: str, largest: bool = True) -> DataFrame:
        """(run, value, place) by a metric; runs without it or whose value is no number are left out, equal values go by name."""
        value = F.col("value").try_cast("double")
        rows = self.read().filter((F.col("kind") == "metric") & (F.col("name") == metric)).select("run", value.alias("value")).filter("value is not null and not isnan(value)")
        key = F.col("value").desc() if largest else F.col("value").asc()
        better = F.row_number().over(Window.orderBy(key, "run"))  # a row a run
        return rows.withColumn("place", better)
