"""Dataset manifests and approvals: canonical JSON under SHA-256."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file under a path that Spark reads; hashed where the data is.

    A file goes by its path under the given one, so that equal names in two folders are told apart, and by its name alone
    where the path is the file itself or a pattern.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    name = F.when(F.col("path").startswith(root), F.substring("path", len(root) + 1, 1 << 30)).otherwise(F.regexp_extract("path", "[^/]+$", 0))
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, path: str, schema: object, config: dict, generated_at: str) -> dict:
    """What a dataset is made of; ``dataset_id`` is the digest of everything but the time."""
    files = [r.asDict() for r in file_digests(spark, path).orderBy("file", "sha256").collect()]
    body = {"schema": schema, "files": files, "config": digest(config)}
    return body | {"dataset_id": digest(body), "generated_at": generated_at}


def approve(manifest_: dict, by: str, path: str | Path, approved_at: str) -> dict:
    """Write an approval once; a second one for the same place is an error."""
    body = {"dataset_id": manifest_["dataset_id"], "approved_by": by, "approved_at": approved_at}
    record = body | {"digest": digest(body)}
    with open(path, "x") as f:
        f.write(canonical_json(record))
    return record


def check_approval(manifest_: dict, path: str | Path) -> dict:
    """The approval, if it is intact and for this dataset."""
    record = json.loads(Path(path).read_text())
    body = {k: v for k, v in record.items() if k != "digest"}
    if digest(body) != record.get("digest"):
        raise ValueError("the approval was changed")
    if body["dataset_id"] != manifest_["dataset_id"]:
        raise ValueError("the approval is for another dataset")
    return record


def flatten(params: dict, prefix: str = "") -> dict[str, object]:
    """Nested parameters as dotted names."""
    out: dict[str, object] = {}
    for k, v in params.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def run_metadata(spark: SparkSession, run: str, params: dict, metrics: dict[str, float]) -> DataFrame:
    """(run, kind, name, value) rows of a run's parameters and metrics."""
    rows = [(run, "param", k, str(v)) for k, v in sorted(flatten(params).items())] + [(run, "metric", k, repr(float(v))) for k, v in sorted(metrics.items())]
    return spark.createDataFrame(rows, "run string, kind string, name string, value string")
