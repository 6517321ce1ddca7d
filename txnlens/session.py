"""Validated settings to a SparkSession whose time zone is UTC."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class SparkSettings:
    app_name: str = "txnlens"
    master: str | None = None
    driver_memory: str = "4g"
    shuffle_partitions: int = 32
    ui: bool = False

    def __post_init__(self) -> None:
        if not self.app_name:
            raise ValueError("app_name must not be empty")
        if self.shuffle_partitions < 1:
            raise ValueError("shuffle_partitions must be at least 1")
        if self.master is not None and not self.master:
            raise ValueError("master must be null or not empty")


def create_session(settings: SparkSettings = SparkSettings()) -> SparkSession:
    """A session under ``settings``; without a master, the one that spark-submit gives."""
    builder = SparkSession.builder.appName(settings.app_name)
    if settings.master:
        builder = builder.master(settings.master)
    return (
        builder.config("spark.driver.memory", settings.driver_memory)
        .config("spark.sql.shuffle.partitions", settings.shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", str(settings.ui).lower())
        .getOrCreate()
    )
