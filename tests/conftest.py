import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(autouse=True)
def _workspaces():
    yield
    from timberline.runtime import close_workspaces

    close_workspaces()


@pytest.fixture()
def las(spark):
    """Makes a cloud table from rows (point_id, x, y, z) with optional columns."""

    def make(rows, treeID=None, scan_id=None, verticality=None, cls=None, **extra):
        cols = "point_id bigint, scan_id bigint, X double, Y double, Z double, Classification int, treeID int, verticality double, gps_time timestamp"
        pickd = lambda v, i, d: v[i] if isinstance(v, list) else (v if v is not None else d)
        data = [(r[0], pickd(scan_id, i, 1), r[1], r[2], r[3], pickd(cls, i, 5), treeID[i] if isinstance(treeID, list) else treeID, pickd(verticality, i, 0.5), None) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, cols)

    return make
