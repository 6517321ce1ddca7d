import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("txnlens-tests").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g")
        .config("spark.sql.codegen.wholeStage", "false").config("spark.sql.codegen.factoryMode", "NO_CODEGEN")  # tiny tables: compiling costs more than running
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def transactions(spark):
    """Canonical rows from (id, time, type, amount, origin before/after, destination before/after, label)."""
    from txnlens.schemas import CANONICAL

    def make(*rows, origin="A", destination="M"):
        data = []
        for i, (at, kind, amount, ob, oa, db, da, label) in enumerate(rows):
            data.append((f"{i:064d}", at, kind, origin, destination, float(amount), float(ob), float(oa), float(db), float(da), label, 0))
        return spark.createDataFrame(data, CANONICAL)

    return make


T0 = datetime(2026, 1, 1, 10)
