"""Differences between two copies of a table: one-sided rows and changed fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, keys: Sequence[str], fields: Mapping[str, Column], version: str | None) -> DataFrame:
    """One row per key with normalised ``fields``: the row with the latest ``version`` (null is the oldest).

    Rows with a null key part are left out, as they identify nothing. Equal versions are decided by the largest normalised
    fields in the order given, so repeated rows and the order of the input don't matter. Only keys, fields and version are read.
    """
    body = F.struct(*([F.col(version).alias("v")] if version else []), *[e.alias(n) for n, e in fields.items()])
    rows = df.select(*keys, body.alias("body")).where(" and ".join(f"`{k}` is not null" for k in keys))
    return rows.groupBy(*keys).agg(F.max("body").alias("body")).select(*keys, *[F.col(f"body.{n}").alias(n) for n in fields])


def residues(left: DataFrame, right: DataFrame) -> DataFrame:
    """EXCEPT ALL in both directions in one exchange: each row that one side has more often, with ``copies`` (negative: right)."""
    cols = left.columns
    both = left.withColumn("copies", F.lit(1)).unionByName(right.withColumn("copies", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("copies").alias("copies")).where("copies <> 0")


def diff(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_fields: Mapping[str, Column],
    right_fields: Mapping[str, Column] | None = None,
    version: str | None = None,
    only_left: str = "missing_in_right",
    only_right: str = "missing_in_left",
) -> DataFrame:
    """(keys..., finding): ``only_left``, ``only_right``, or the name of each field that differs; null equals null.

    The residues of the two EXCEPT ALLs hold at most one row a side and key; they are full-joined by key. Equal rows, the bulk of
    two copies, end at the first aggregation. Extra columns of either table are ignored; an empty side makes every key one-sided.
    """
    names = list(left_fields)
    a = current_rows(left, keys, left_fields, version)
    b = current_rows(right, keys, right_fields or left_fields, version)
    rest = residues(a, b)
    side = lambda cond, p: rest.where(cond).select(*keys, F.struct(*names).alias(p))
    joined = side("copies > 0", "__l").join(side("copies < 0", "__r"), list(keys), "full")
    changed = [
        F.when(F.col("__l").isNotNull() & F.col("__r").isNotNull() & ~F.col(f"__l.{n}").eqNullSafe(F.col(f"__r.{n}")), F.lit(n)) for n in names
    ]
    found = F.array_compact(
        F.array(F.when(F.col("__r").isNull(), F.lit(only_left)), F.when(F.col("__l").isNull(), F.lit(only_right)), *changed)
    )
    return joined.select(*keys, F.explode(found).alias("finding"))
