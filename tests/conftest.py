from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


@pytest.fixture(scope="session")
def same():
    """Whether two frames have the same columns and rows, in any order."""

    def plain(v):
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    def compare(a, b) -> None:
        names = sorted(a.columns)
        assert names == sorted(b.columns)
        rows = [sorted(map(tuple, x[names].astype(object).map(plain).values.tolist())) for x in (a, b)]
        assert len(rows[0]) == len(rows[1])
        assert rows[0] == rows[1]

    return compare
