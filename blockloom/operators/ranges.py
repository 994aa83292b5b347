"""Sets of closed integer intervals as rows ``(keys..., start, end)``.

A set is the rows of one value of ``keys``. Adjacent spans merge, as for integers. Rows with a null bound or start > end aren't spans
and are left out. Extra columns are ignored; empty inputs give empty sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = Sequence[str]


def make(df: DataFrame, keys: Cols, start: Column, end: Column, start_open: Column | None = None, end_open: Column | None = None) -> DataFrame:
    """Spans from bounds; an exclusive bound moves by one. Empty intervals are dropped."""
    s = start.cast("bigint") + (start_open.cast("bigint") if start_open is not None else F.lit(0))
    e = end.cast("bigint") - (end_open.cast("bigint") if end_open is not None else F.lit(0))
    return df.select(*keys, s.alias("start"), e.alias("end")).where("start <= end")


def contains_point(start: Column, end: Column, v: Column) -> Column:
    return (start <= v) & (v <= end)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= e2) & (s2 <= e1)


def touches(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (e1 + 1 == s2) | (e2 + 1 == s1)


def can_merge(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return overlaps(s1, e1, s2, e2) | touches(s1, e1, s2, e2)


def merge(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The one span of two that can merge, else null."""
    return F.when(can_merge(s1, e1, s2, e2), F.struct(F.least(s1, s2).alias("start"), F.greatest(e1, e2).alias("end")))


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.when(overlaps(s1, e1, s2, e2), F.struct(F.greatest(s1, s2).alias("start"), F.least(e1, e2).alias("end")))


def subtract(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """What is left of the first span: an array of 0 to 2 spans."""
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    cut = F.array(F.when(s1 < s2, span(s1, s2 - 1)), F.when(e1 > e2, span(e2 + 1, e1)))
    return F.when(overlaps(s1, e1, s2, e2), F.array_compact(cut)).otherwise(F.array(span(s1, e1)))


def normalize(df: DataFrame, keys: Cols, slice_width: int | None = None) -> DataFrame:
    """Disjoint, non-adjacent spans.

    With ``slice_width`` the spans are first merged within slices of the number line, so that a set with a third of all spans is
    merged by many tasks; the second step then sees one set of merged spans per slice.
    """
    d = df.where("start <= end").select(*keys, "start", "end")
    if slice_width:
        d = _islands(d.withColumn("__sl", F.floor(F.col("start") / slice_width)), [*keys, "__sl"]).drop("__sl")
    return _islands(d, keys)


def _islands(d: DataFrame, keys: Cols) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("__m", F.max("end").over(before))
    d = d.withColumn("__i", F.sum((F.col("__m").isNull() | (F.col("start") > F.col("__m") + 1)).cast("int")).over(upto))
    return d.groupBy(*keys, "__i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__i")


def union(a: DataFrame, b: DataFrame, keys: Cols, slice_width: int | None = None) -> DataFrame:
    return normalize(a.select(*keys, "start", "end").unionByName(b.select(*keys, "start", "end")), keys, slice_width)


def _sweep(a: DataFrame, b: DataFrame, keys: Cols, slice_width: int | None) -> DataFrame:
    """Every stretch (start, end) between two ends of spans, with how many spans of ``a`` and of ``b`` cover it: no join and no row per
    unit or bin, whatever the lengths of the spans."""
    edge = lambda d, side: normalize(d, keys, slice_width).select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("at"), F.lit(-1).alias("d")))).alias("x")).select(
        *keys, "x.at", F.when(F.lit(side == "a"), F.col("x.d")).otherwise(0).alias("da"), F.when(F.lit(side == "b"), F.col("x.d")).otherwise(0).alias("db")
    )
    e = edge(a, "a").unionByName(edge(b, "b")).groupBy(*keys, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy(*keys).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("ina", F.sum("da").over(run)).withColumn("inb", F.sum("db").over(run)).withColumn("next", F.lead("at").over(w))
    return e.select(*keys, F.col("at").alias("start"), (F.col("next") - 1).alias("end"), "ina", "inb")


def intersect(a: DataFrame, b: DataFrame, keys: Cols, slice_width: int | None = None) -> DataFrame:
    return normalize(_sweep(a, b, keys, slice_width).where("ina > 0 and inb > 0").select(*keys, "start", "end"), keys, slice_width)


def difference(a: DataFrame, b: DataFrame, keys: Cols, slice_width: int | None = None) -> DataFrame:
    """Parts of ``a`` outside ``b``."""
    return normalize(_sweep(a, b, keys, slice_width).where("ina > 0 and inb = 0").select(*keys, "start", "end"), keys, slice_width)


def complement(df: DataFrame, universe: DataFrame, keys: Cols, slice_width: int | None = None) -> DataFrame:
    """``universe`` has (keys..., start, end); sets without any span keep their whole universe."""
    return difference(universe, df, keys, slice_width)


def contains_values(df: DataFrame, values: DataFrame, keys: Cols, value: str, slice_width: int | None = None) -> DataFrame:
    """``values`` with ``contained``: whether the set of its keys holds the value; a null value is in no set.

    A value is in the set if the furthest end of the spans that begin at or before it isn't before it: one running maximum over spans
    and values together. With ``slice_width`` the maximum runs within slices of the number line and the maxima of the slices before are
    added, so a set with a third of all rows is worked on by many tasks.
    """
    at = F.struct("__at", "__kind")
    spans = normalize(df, keys, slice_width).select(*keys, F.col("start").alias("__at"), F.lit(0).alias("__kind"), F.col("end").alias("__end"), F.lit(None).cast(values.schema).alias("__row"))
    rows = spans.unionByName(values.select(*keys, F.col(value).cast("bigint").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("bigint").alias("__end"), F.struct(*values.columns).alias("__row")))
    rows = rows.withColumn("__sl", F.floor(F.col("__at") / slice_width) if slice_width else F.lit(0).cast("bigint"))
    w = Window.partitionBy(*keys, "__sl").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    far = F.max("__end").over(w)
    if slice_width:
        before = Window.partitionBy(*keys).orderBy("__sl").rowsBetween(Window.unboundedPreceding, -1)
        ends = rows.groupBy(*keys, "__sl").agg(F.max("__end").alias("__end")).withColumn("__before", F.max("__end").over(before))
        ends = ends.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "__sl"])], "__before")
        rows = rows.withColumn("__far", far)
        on = [rows[k].eqNullSafe(ends[f"__k{i}"]) for i, k in enumerate([*keys, "__sl"])]
        rows, far = rows.join(ends, on), F.greatest("__far", "__before")
    got = rows.withColumn("__far", far).where("__kind = 1")
    return got.select(*[F.col(f"__row.`{c}`").alias(c) for c in values.columns], F.coalesce(F.col("__far") >= F.col("__at"), F.lit(False)).alias("contained"))


def covered_length(df: DataFrame, keys: Cols, slice_width: int | None = None) -> DataFrame:
    return normalize(df, keys, slice_width).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered"))


def missing_within(df: DataFrame, window: DataFrame, keys: Cols) -> DataFrame:
    """The uncovered parts of each set's window."""
    return complement(df, window, keys)


def next_gap(df: DataFrame, keys: Cols, at: int) -> DataFrame:
    """(keys..., start, end) of the first gap at or after ``at``. A gap ends before the next span: the open end after the last span is
    none. It begins at ``at`` if that is uncovered."""
    n = normalize(df, keys)
    g = n.withColumn("__next", F.lead("start").over(Window.partitionBy(*keys).orderBy("start")))
    gaps = g.where(F.col("__next").isNotNull()).select(*keys, (F.col("end") + 1).alias("start"), (F.col("__next") - 1).alias("end"))
    head = n.groupBy(*keys).agg(F.min("start").alias("__s")).where(F.col("__s") > at).select(*keys, F.lit(at).cast("bigint").alias("start"), (F.col("__s") - 1).alias("end"))
    every = gaps.unionByName(head).where(F.col("end") >= at).withColumn("start", F.greatest("start", F.lit(at).cast("bigint")))
    return every.groupBy(*keys).agg(F.min(F.struct("start", "end")).alias("g")).select(*keys, "g.start", "g.end")


def progress(df: DataFrame, totals: DataFrame, keys: Cols, total: str) -> DataFrame:
    """(keys..., covered, total, share, complete) of transfers."""
    j = totals.join(covered_length(df, keys), list(keys), "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return j.select(*keys, "covered", total, F.try_divide("covered", F.col(total)).alias("share"), (F.col("covered") >= F.col(total)).alias("complete"))


def parse_http_range(header: Column, size: Column) -> Column:
    """``bytes=a-b``, ``bytes=a-`` or ``bytes=-n`` of one range as struct(start, end); null if it can't be satisfied."""
    pat = r"^\s*bytes\s*=\s*(\d*)\s*-\s*(\d*)\s*$"
    a = F.nullif(F.regexp_extract(header, pat, 1), F.lit("")).cast("bigint")
    b = F.nullif(F.regexp_extract(header, pat, 2), F.lit("")).cast("bigint")
    start = F.when(a.isNotNull(), a).otherwise(F.greatest(size - b, F.lit(0)))
    end = F.when(a.isNotNull(), F.least(F.coalesce(b, size - 1), size - 1)).otherwise(size - 1)
    return F.when((a.isNotNull() | b.isNotNull()) & (start <= end), F.struct(start.alias("start"), end.alias("end")))
