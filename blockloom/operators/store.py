"""Content-addressed store: blocks, manifests, read-back and verification as tables.

A block is ``(block_key, size, ...)``, a manifest entry ``(blob_key, ordinal, block_key, start, end)``. Blocks are written once per key;
a manifest is the ordered list of a blob's blocks. Rows without a key are left out by every function.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions import digests as D
from blockloom.operators import chunking

PAGE_ENTRIES = 16384


def keyed_blocks(blocks: DataFrame, data: str = "block", algo: str = "sha-256") -> DataFrame:
    """Blocks with ``block_key`` and ``size``; empty blocks have no key and are skipped."""
    return blocks.where(F.octet_length(data) > 0).withColumn("block_key", D.block_key_of(F.col(data), algo)).withColumn("size", F.octet_length(data).cast("bigint"))


def put_blocks(blocks: DataFrame, order: Sequence[str], existing: DataFrame | None = None, key: str = "block_key") -> DataFrame:
    """Blocks with ``status``: Duplicate if the key is in ``existing`` or came earlier in ``order``, else Fresh.

    The first position of each key comes from one aggregation that combines on the map side, so a key with a third of all blocks
    costs no more than any other; a row is Fresh exactly at that position.
    """
    first = blocks.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    if existing is not None:
        first = first.join(existing.select(F.col(key)).distinct(), key, "left_anti")
    f = first.select(F.col(key).alias("__k"), *[F.col(f"__first.{o}").alias(f"__o{i}") for i, o in enumerate(order)])
    on = F.col(key) == F.col("__k")
    for i, o in enumerate(order):
        on = on & F.col(o).eqNullSafe(F.col(f"__o{i}"))
    marked = blocks.where(F.col(key).isNotNull()).join(f, on, "left")
    return marked.withColumn("status", F.when(F.col("__k").isNotNull(), "Fresh").otherwise("Duplicate")).drop("__k", *[f"__o{i}" for i in range(len(order))])


def forward_duplicates(put: DataFrame) -> DataFrame:
    """The duplicates that are passed on without being stored again."""
    return put.where(F.col("status") == "Duplicate").withColumn("status", F.lit("Forwarded"))


def ingest_stats(put: DataFrame, keys: Sequence[str], size: str = "size") -> DataFrame:
    """(keys..., total_bytes, block_count, fresh_blocks, duplicate_blocks, dedup_ratio): ratio 0 without blocks."""
    g = put.groupBy(*keys).agg(
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.count(F.lit(1)).alias("block_count"),
        F.sum((F.col("status") == "Fresh").cast("bigint")).alias("fresh_blocks"),
        F.sum((F.col("status") != "Fresh").cast("bigint")).alias("duplicate_blocks"),
    )
    return g.withColumn("dedup_ratio", F.coalesce(F.try_divide("duplicate_blocks", "block_count"), F.lit(0.0)))


def build_manifest(blocks: DataFrame, blob: str, order: Sequence[str], key: str = "block_key", size: str = "size") -> DataFrame:
    """(blob, ordinal, block_key, start, end) with offsets as running sums of the sizes."""
    w = Window.partitionBy(blob).orderBy(*order)
    end = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = blocks.withColumn("__e", end).withColumn("ordinal", F.row_number().over(w).cast("bigint") - 1)
    return d.select(blob, "ordinal", key, (F.col("__e") - F.col(size)).alias("start"), (F.col("__e") - 1).alias("end"))


def manifest_sizes(manifest: DataFrame, blob: str) -> DataFrame:
    """(blob, entries, covered, size): ``covered`` is the sum of the lengths, ``size`` the last end + 1; they differ where there are gaps."""
    return manifest.groupBy(blob).agg(F.count(F.lit(1)).alias("entries"), F.sum(F.col("end") - F.col("start") + 1).alias("covered"), (F.max("end") + 1).alias("size"))


def validate_manifest(manifest: DataFrame, blob: str, declared: DataFrame | None = None) -> DataFrame:
    """(blob, violations): entries out of order or overlapping, invalid spans, and a declared size that isn't the last end + 1.
    Gaps are allowed. Valid blobs have an empty array."""
    w = Window.partitionBy(blob).orderBy("ordinal")
    d = manifest.withColumn("__prev", F.lag("end").over(w))
    bad = F.when((F.col("start") < 0) | (F.col("end") < F.col("start")), F.concat(F.lit("invalid span at "), F.col("ordinal").cast("string"))).when(
        F.col("__prev") >= F.col("start"), F.concat(F.lit("overlap at "), F.col("ordinal").cast("string"))
    )
    g = d.groupBy(blob).agg(F.array_sort(F.collect_list(bad)).alias("violations"), (F.max("end") + 1).alias("__size"))
    if declared is not None:
        g = declared.select(blob, "size").join(g, blob, "left")
        g = g.withColumn("violations", F.concat(F.coalesce("violations", F.array().cast("array<string>")), F.when(~F.col("size").eqNullSafe(F.coalesce("__size", F.lit(0))), F.array(F.lit("size differs"))).otherwise(F.array().cast("array<string>"))))
    return g.select(blob, "violations")


def paginate(manifest: DataFrame, blob: str, per_page: int = PAGE_ENTRIES) -> DataFrame:
    """(blob, page, entries, start, end)"""
    return manifest.groupBy(blob, F.floor(F.col("ordinal") / per_page).alias("page")).agg(F.count(F.lit(1)).alias("entries"), F.min("start").alias("start"), F.max("end").alias("end"))


def validate_root(pages: DataFrame, blob: str) -> DataFrame:
    """(blob, pages, ok): pages numbered without holes, each with entries, in order and without overlap."""
    w = Window.partitionBy(blob).orderBy("page")
    d = pages.withColumn("__ok", (F.col("entries") > 0) & (F.col("page") == F.row_number().over(w) - 1) & F.coalesce(F.lag("end").over(w) < F.col("start"), F.lit(True)))
    return d.groupBy(blob).agg(F.count(F.lit(1)).alias("pages"), F.min("__ok").alias("ok"))


def read_back(manifest: DataFrame, blocks: DataFrame, blob: str, data: str = "block", key: str = "block_key") -> DataFrame:
    """(blob, size, missing, data): each blob's bytes joined in order; data is null where a block is missing."""
    b = blocks.select(key, F.col(data).alias("__d")).dropDuplicates([key])
    j = manifest.join(b, key, "left")
    g = j.groupBy(blob).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.hex("__d").alias("x")))).alias("__b"), F.sum(F.col("__d").isNull().cast("int")).alias("missing"))
    return g.select(blob, "missing", F.when(F.col("missing") == 0, F.unhex(F.array_join(F.transform("__b", lambda e: e["x"]), ""))).alias("data")).withColumn("size", F.octet_length("data").cast("bigint"))


def stat(manifest: DataFrame, blob: str, ingested: DataFrame | None = None) -> DataFrame:
    """(blob, size, blocks[, ingested_at]): size is the sum of the span lengths."""
    g = manifest.groupBy(blob).agg(F.sum(F.col("end") - F.col("start") + 1).alias("size"), F.count(F.lit(1)).alias("blocks"))
    return g if ingested is None else g.join(ingested, blob, "left")


def delete(manifest: DataFrame, gone: DataFrame, blob: str) -> DataFrame:
    """The manifest without the blobs in ``gone``; their blocks stay."""
    return manifest.join(gone.select(blob).distinct(), blob, "left_anti")


def verify_blobs(back: DataFrame, blob: str, expected: Column, algo: str = "sha-256") -> DataFrame:
    """(blob, actual, ok): a missing block or another digest isn't ok."""
    actual = D.hashed(F.col("data"), algo)
    return back.select(blob, actual.alias("actual"), F.coalesce(actual == expected, F.lit(False)).alias("ok"))


def verify_stored(manifest: DataFrame, blocks: DataFrame, blob: str, expected: DataFrame, algo: str = "sha-256", data: str = "block", key: str = "block_key") -> DataFrame:
    """(blob, actual, ok) of the blobs of a manifest against ``expected`` (blob, expected), whatever their size: the blocks are hashed one
    after the other in order, a blob is never put together. A missing block or another digest isn't ok."""
    import hashlib

    from blockloom.operators.transduce import fold_emit

    new = {"sha-256": hashlib.sha256, "sha-1": hashlib.sha1}[algo]

    def machine(rows):
        h, whole = new(), True
        for (d,) in rows:
            if d is None:
                whole = False
            elif whole:
                h.update(d)
        yield (h.hexdigest() if whole else None,)

    b = blocks.select(key, F.col(data).alias("__d")).dropDuplicates([key])
    got = fold_emit(manifest.join(b, key, "left"), [blob], ["ordinal"], ["__d"], "actual string", machine)
    return got.join(expected.select(blob, "expected"), blob, "left").select(blob, "actual", F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)).alias("ok"))


def read_rows(manifest: DataFrame, blocks: DataFrame, blob: str, data: str = "block", key: str = "block_key") -> DataFrame:
    """(blob, ordinal, start, data): the blocks of each blob, each blob's in order within one partition, for blobs of any size; data is
    null where a block is missing. Write it out or go through it with ``fold_emit``; :func:`read_back` joins blobs of below 1 GB."""
    b = blocks.select(key, F.col(data).alias("data")).dropDuplicates([key])
    return manifest.join(b, key, "left").select(blob, "ordinal", "start", "data").repartition(blob).sortWithinPartitions(blob, "ordinal")


def verify_stream(df: DataFrame, part: Sequence[str], order: Sequence[str], data: str, n: int, keys: DataFrame) -> DataFrame:
    """A stream of chunks against the block keys of its blob: re-blocked to ``n`` bytes, then as :func:`verify_blocks`."""
    return verify_blocks(keyed_blocks(chunking.rechunk(df, part, order, data, n)), keys, part)


def verify_blocks(blocks: DataFrame, keys: DataFrame, part: Sequence[str]) -> DataFrame:
    """(part..., block_index, result, expected, actual) by position: Passed, Failed, or Error for a block beyond the list.
    Listed blocks that don't come are not reported. ``keys`` has (part..., block_index, expected)."""
    j = blocks.select(*part, "block_index", F.col("block_key").alias("actual")).join(keys, [*part, "block_index"], "left")
    r = F.when(F.col("expected").isNull(), "Error").when(F.col("expected") == F.col("actual"), "Passed").otherwise("Failed")
    return j.select(*part, "block_index", r.alias("result"), "expected", "actual")


def ingest_bytes(objects: DataFrame, blob: str, data: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(blocks, manifest) of whole objects in fixed blocks; objects without bytes are left out (an empty blob is an error upstream).

    A delimiter mode that drops bytes can't be used here: what is read back would differ from the blob's digest.
    """
    b = keyed_blocks(chunking.fixed_blocks(objects, [blob], data, block_bytes))
    return b, build_manifest(b, blob, ["block_index"])


def resolve_attributes(advertised: DataFrame, confirmed: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, fields...): the confirmed value, else the advertised one."""
    a = advertised.select(key, *[F.col(f).alias(f"__a_{f}") for f in fields])
    c = confirmed.select(key, *[F.col(f).alias(f"__c_{f}") for f in fields])
    return a.join(c, key, "full").select(key, *[F.coalesce(f"__c_{f}", f"__a_{f}").alias(f) for f in fields])


def diff_attributes(advertised: DataFrame, confirmed: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, state, advertised, confirmed): Missing, OnlyAdvertised, OnlyConfirmed or Both. Values as text."""
    side = lambda d, p: d.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(p)) for f in fields])).alias("x")).select(key, "x.field", f"x.{p}")
    j = side(advertised, "advertised").join(side(confirmed, "confirmed"), [key, "field"], "full")
    s = F.when(F.col("advertised").isNull() & F.col("confirmed").isNull(), "Missing").when(F.col("confirmed").isNull(), "OnlyAdvertised").when(F.col("advertised").isNull(), "OnlyConfirmed").otherwise("Both")
    return j.select(key, "field", s.alias("state"), "advertised", "confirmed")
