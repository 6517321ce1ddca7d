import pathlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from txnlens.llm import common


def test_parts_cut_few_long_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["x" * 10_000_000, None, "y" * 10_000_000, "z" * 10_000_000, ""])], names=["id", "text"])
    pieces = list(common.parts([batch, batch.slice(0, 0)], 1))
    assert [p.column(0).to_pylist() for p in pieces] == [[0, 1], [2], [3, 4]]
    both = pa.RecordBatch.from_arrays([pa.array(["a" * 6] * 4), pa.array(["b" * 6] * 4)], names=["a", "b"])
    assert [p.num_rows for p in common.parts([both], (0, 1), 24)] == [2, 2]


def test_tables_are_written_and_forgotten(spark):
    before = {k: spark.conf.get(k) for k in common._OWN}
    table = common.materialize(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count())
    at = pathlib.Path(table._txnlens_path.removeprefix("file://"))
    assert table.count() == 3 and at.is_dir() and {k: spark.conf.get(k) for k in common._OWN} == before
    common.forget(table)
    assert not at.exists()


def test_a_block_owns_its_tables(spark):
    there = lambda t: pathlib.Path(t._txnlens_path.removeprefix("file://")).is_dir()
    with common.scratch() as outer:
        with common.scratch() as keep:
            a, b, c = (common.materialize(spark.range(k)) for k in (1, 2, 3))
            keep(b)
            keep(c)
        assert [there(t) for t in (a, b, c)] == [False, True, True]
        outer(c)
    assert [there(t) for t in (b, c)] == [False, True]
    with pytest.raises(RuntimeError), common.scratch():
        d = common.materialize(spark.range(4))
        raise RuntimeError
    assert not there(d) and c.count() == 3
    common.forget(c)


def test_workers_keep_one_thing():
    made = []
    for key in ("a", "a", "b", "a"):
        common.kept(key, lambda key=key: made.append(key) or key)
    assert made == ["a", "b", "a"]
    list(common.parts([], 0, keeps=True))
    assert common._kept
    list(common.parts([], 0))
    assert not common._kept


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Cluster:
        conf, sparkContext = Conf, type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Cluster)
