"""Shared working folder and written intermediates.

Executors can be lost at any time, so an intermediate that is read more than once is a Parquet table in the folder that all
executors share (``spark.checkpoint.dir``); nothing here keeps its only copy in an executor's memory.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary folder of our own only where the session names none (as in tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="blockloom-")
    return _LOCAL[app]


def fresh_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder; unless kept, :func:`release` removes it, at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/blockloom/{name}-{uuid.uuid4().hex[:12]}"
    if not keep:
        if not _MADE:
            atexit.register(release)
        _MADE.append((spark, path))
    return path


def release() -> None:
    """Removes the intermediate tables made so far. Frames that read them can't be used any more."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001, S110 - the driver is ending; what can't be reached stays
            pass


def drop(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and is computed a single time."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
