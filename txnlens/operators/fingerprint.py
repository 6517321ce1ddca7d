"""Content fingerprints: an id of a table's rows that does not depend on files, partitions or the order of rows."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import canonical_json, digest


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of a row: each value's type-free text with its length before it, so that no two rows run together; null is ``-``."""
    cell = lambda c: F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-"))
    text = lambda c: F.col(f"`{c}`").cast("string")
    return F.sha2(F.concat_ws(",", *[cell(text(c)) for c in columns]), 256)


def content(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(row_count, low, high): the sums over all rows of two 60-bit parts of the rows' digests.

    Sums commute, so one aggregate with a partial sum in each task is enough, and repeated rows count as often as they
    occur. Columns of arrays, structs or maps go as their JSON. An empty table has sums of zero.
    """
    nested = {n: F.to_json(F.struct(F.col(f"`{n}`").alias("v"))) for n, kind in df.dtypes if kind.split("<")[0] in ("array", "struct", "map")}
    src = df.withColumns(nested) if nested else df
    d = src.select(row_digest(sorted(columns or df.columns)).alias("d"))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring("d", at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).cast("string")
    return d.agg(F.count(F.lit(1)).alias("row_count"), part(1).alias("low"), part(16).alias("high"))


def code_digest(folder: str | Path, pattern: str = "*.py") -> str:
    """SHA-256 over the names and contents of the source files under a folder, in order of name."""
    folder = Path(folder)
    files = sorted(p for p in folder.rglob(pattern) if "__pycache__" not in p.parts)
    return digest([[p.relative_to(folder).as_posix(), hashlib.sha256(p.read_bytes()).hexdigest()] for p in files])


def manifest(parts: dict[str, DataFrame], config: dict, generated_at: str, code: str | None = None, time: str | None = None) -> dict:
    """What a dataset is made of: for each part its schema, rows, content and range of times; configuration and code.

    ``dataset_id`` is the digest of everything but ``generated_at``: the same rows have the same id however they are stored.
    """
    body: dict = {"config": digest(config), "code": code, "parts": {}}
    for name, df in sorted(parts.items()):
        row = content(df).first()
        entry = {"schema": [[f.name, f.dataType.simpleString()] for f in sorted(df.schema, key=lambda f: f.name)], "row_count": row["row_count"], "content": hashlib.sha256(canonical_json([row["row_count"], row["low"], row["high"]]).encode()).hexdigest()}
        if time:
            span = df.agg(F.min(time).cast("string"), F.max(time).cast("string")).first()
            entry["time_range"] = [span[0], span[1]]
        body["parts"][name] = entry
    return body | {"dataset_id": digest(body), "generated_at": generated_at}
