import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as sorted tuples of plain values."""

    def plain(v):
        if isinstance(v, (bytes, bytearray)):
            return bytes(v)
        if isinstance(v, list):
            return tuple(plain(x) for x in v)
        return tuple(map(plain, v)) if hasattr(v, "asDict") else v

    def get(df, *cols):
        d = df.select(*cols) if cols else df
        return sorted((tuple(plain(v) for v in r) for r in d.collect()), key=lambda t: tuple((x is not None, str(type(x)), x) if not isinstance(x, dict) else (True, "dict", str(x)) for x in t))

    return get
