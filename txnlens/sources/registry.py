"""Model registry: saved pipelines, and a log of versions, tags and alias moves, an entry a file, whose order is what happened.

An entry's name is its number, and it is created only if no one else has: a writer that comes second reads the log again and
decides anew. Where the folder is local that is a hard link, elsewhere a rename that does not replace, which file systems
such as HDFS do in one step. Entries are never changed; a move whose follow-up fails is undone by an entry of its own.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "at timestamp, seq long, action string, name string, version long, alias string, path string, actor string, note string, key string, undoes long"
#: How often a writer that is overtaken tries again.
RETRIES = 50


class Registry:
    """Appends only; current state is derived. ``folder`` is any folder that Spark writes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _file_system(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def log(self) -> DataFrame:
        at, fs = self._file_system(f"{self.folder}/log")
        return self.spark.read.schema(_SCHEMA).json(f"{self.folder}/log") if fs.exists(at) else self.spark.createDataFrame([], _SCHEMA)

    def _create(self, seq: int, record: dict) -> bool:
        """Whether the entry could be put under its number, whole or not at all."""
        text = json.dumps({k: v for k, v in ({"seq": seq} | record).items() if v is not None}, default=str, sort_keys=True).encode()
        folder, fs = self._file_system(f"{self.folder}/log")
        fs.mkdirs(folder)
        temporary, fs = self._file_system(f"{self.folder}/log/_{uuid.uuid4().hex}")
        final, _ = self._file_system(f"{self.folder}/log/{seq:012d}.json")
        out = fs.create(temporary, False)
        out.write(bytearray(text))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                try:
                    os.link(temporary.toUri().getPath(), final.toUri().getPath())
                    return True
                except FileExistsError:
                    return False
            return not fs.exists(final) and fs.rename(temporary, final)
        finally:
            if fs.exists(temporary):
                fs.delete(temporary, False)

    def _commit(self, make: Callable[[list[Row]], dict | None]) -> dict | None:
        """Append what ``make`` decides from the log as it stands; None appends nothing."""
        for _ in range(RETRIES):
            entries = self.log().orderBy("seq").collect()
            record = make(entries)
            if record is None:
                return None
            seq = (entries[-1]["seq"] if entries else 0) + 1
            if self._create(seq, record):
                return record | {"seq": seq}
        raise RuntimeError(f"overtaken {RETRIES} times by other writers")

    def register(self, name: str, model: PipelineModel, at: datetime, note: str | None = None) -> int:
        path = f"{self.folder}/models/{name}/{uuid.uuid4().hex}"
        model.save(path)
        version = lambda log: 1 + max((e["version"] for e in log if e["action"] == "register" and e["name"] == name), default=0)
        return self._commit(lambda log: {"at": at, "action": "register", "name": name, "version": version(log), "path": path, "note": note})["version"]

    @staticmethod
    def _history(log: list[Row], name: str, alias: str) -> list[tuple[int, int]]:
        """(seq, version) of an alias' moves that were not undone, in order."""
        moves = [e for e in log if e["name"] == name and e["alias"] == alias]
        undone = {e["undoes"] for e in moves if e["action"] == "undo"}
        return [(e["seq"], e["version"]) for e in moves if e["action"] in ("promote", "rollback") and e["seq"] not in undone]

    def aliases(self) -> DataFrame:
        """(name, alias, version) as they stand."""
        log = self.log()
        undone = log.filter("action = 'undo'").select(F.col("undoes").alias("seq"))
        moves = log.filter(F.col("action").isin("promote", "rollback")).join(undone, "seq", "left_anti")
        return moves.groupBy("name", "alias").agg(F.max_by("version", "seq").alias("version"))

    def current(self, name: str, alias: str) -> int | None:
        row = self.aliases().filter((F.col("name") == name) & (F.col("alias") == alias)).first()
        return row["version"] if row else None

    def _move(self, make: Callable[[list[Row]], dict], then: Callable[[dict], None] | None) -> dict:
        """Write a move, then do what follows from it; if that fails, the move is undone and the error goes on.

        A move that another has replaced meanwhile is left as it is.
        """
        done = self._commit(make)
        if then:
            try:
                then(done)
            except BaseException as e:
                undo = {k: done[k] for k in ("at", "name", "alias", "version", "actor")} | {"action": "undo", "undoes": done["seq"], "note": f"{type(e).__name__}: {e}"[:500]}
                self._commit(lambda log: undo if (self._history(log, done["name"], done["alias"]) or [(None, None)])[-1][0] == done["seq"] else None)
                raise
        return done

    def promote(self, name: str, version: int, alias: str, actor: str, at: datetime, approved: bool, note: str | None = None, then: Callable[[dict], None] | None = None) -> None:
        """Point an alias at a version; ``then`` is what has to succeed with it, such as telling the servers."""
        if not approved:
            raise ValueError("only an approved version can be promoted")

        def make(log: list[Row]) -> dict:
            if not any(e["action"] == "register" and e["name"] == name and e["version"] == version for e in log):
                raise ValueError(f"{name} has no version {version}")
            return {"at": at, "action": "promote", "name": name, "version": version, "alias": alias, "actor": actor, "note": note}

        self._move(make, then)

    def rollback(self, name: str, alias: str, actor: str, at: datetime, note: str | None = None, then: Callable[[dict], None] | None = None) -> int:
        """Move an alias back to the version it had before the current one."""

        def make(log: list[Row]) -> dict:
            moves = self._history(log, name, alias)
            earlier = [v for _, v in moves if v != moves[-1][1]]
            if not earlier:
                raise ValueError(f"{name} has nothing to roll {alias} back to")
            return {"at": at, "action": "rollback", "name": name, "version": earlier[-1], "alias": alias, "actor": actor, "note": note}

        return self._move(make, then)["version"]

    def tag(self, name: str, version: int, key: str, value: str, actor: str, at: datetime) -> None:
        self._commit(lambda log: {"at": at, "action": "tag", "name": name, "version": version, "key": key, "note": value, "actor": actor})

    def tags(self, name: str, version: int) -> dict[str, str]:
        """The tags of a version, each as it was last set."""
        rows = self.log().filter((F.col("action") == "tag") & (F.col("name") == name) & (F.col("version") == version))
        return {r["key"]: r["value"] for r in rows.groupBy("key").agg(F.max_by("note", "seq").alias("value")).collect()}

    def load(self, name: str, version: int) -> PipelineModel:
        row = self.log().filter((F.col("action") == "register") & (F.col("name") == name) & (F.col("version") == version)).first()
        if row is None:
            raise ValueError(f"{name} has no version {version}")
        return PipelineModel.load(row["path"])
