"""References to records that do not exist, exist only deleted, or came later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators import membership as M
from blockloom.workspace import written


def parent_summary(parents: DataFrame, key: str, created: str, deleted: str) -> DataFrame:
    """(key, all_deleted, first_created) of each non-null parent key, combined on the map side."""
    return (
        parents.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.min(F.col(deleted).isNotNull()).alias("all_deleted"), F.min(created).alias("first_created"))
    )


def reference_summary(refs: DataFrame, key: str, created: str) -> DataFrame:
    """(key, ref_month, first_ref, n_refs): a key referred to by a third of all rows becomes one row a month and task."""
    return (
        refs.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"), F.date_format(created, "yyyy-MM").alias("ref_month"))
        .agg(F.min(created).alias("first_ref"), F.count(F.lit(1)).alias("n_refs"))
    )


def orphans(references: dict[str, DataFrame], parents: DataFrame, n_words: int | None = None) -> DataFrame:
    """(table_name, ref_month, key, n_refs, reason, proven_by) of every reference that doesn't hold.

    ``references`` maps table names to :func:`reference_summary` frames, ``parents`` is a :func:`parent_summary`. A Bloom filter
    of the parent keys is broadcast while its size stays within the bound in :mod:`membership`; what it rejects is ``missing``
    with no further work (``proven_by`` filter). Only the rest is joined to the parents. ``n_refs`` counts the month's references
    of the key. A null time of the reference or of all parents can't make a reference late; empty parents make everything missing.
    """
    parents = written(parents, "parents")
    n_words = n_words or M.words_for(parents.count())
    filt = M.build_filter(parents, "key", n_words)
    refs = None
    for name, r in references.items():
        r = r.withColumn("table_name", F.lit(name))
        refs = r if refs is None else refs.unionByName(r)
    probed = written(M.probe_filter(refs, "key", filt, n_words), "probed")
    out = ["table_name", "ref_month", "key", "n_refs"]
    definite = probed.where("not maybe").select(*out, F.lit("missing").alias("reason"), F.lit("filter").alias("proven_by"))
    found = parents.withColumn("found", F.lit(True))
    verified = probed.where("maybe").join(found, "key", "left")
    reason = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("all_deleted"), "deleted")
        .when(F.col("first_created") > F.col("first_ref"), "late")
    )
    verified = verified.withColumn("reason", reason).where("reason is not null").select(*out, "reason", F.lit("join").alias("proven_by"))
    return definite.unionByName(verified)
