import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for Python workers


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("weirflow-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables aren't here")
    return path


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    """A value that compares and sorts alike from both engines."""
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def same_rows(frame, relation) -> None:
    """A DataFrame against an executed DuckDB query: column names and rows, in any order."""
    names = [d[0] for d in relation.description]
    assert sorted(frame.columns) == sorted(names)
    order = sorted(names)
    expected = [tuple(plain(r[names.index(c)]) for c in order) for r in relation.fetchall()]
    found = [tuple(plain(r[c]) for c in order) for r in frame.collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
