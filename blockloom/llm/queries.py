"""The queries p1_, p3_, p5_, p7_, p8_ and p9_, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import identity as I
from blockloom.llm.history_dedup import BatchHistory, block_rows, by_batch, duplicate_blocks
from blockloom.llm.leakage import leak_report, leaks
from blockloom.llm.mixing import mix
from blockloom.llm.packing import fill_report, pack
from blockloom.llm.reading_level import levels, profile
from blockloom.llm.seen_keys import SeenKeys, error_report
from blockloom.workspace import fresh_path, table

# ---- p1: ingests that repeat an accepted one ----
def _p1(spark: SparkSession, sf: str) -> BatchHistory:
    """All batches, one after the other, each in a call of its own."""
    path = fresh_path(spark, "batches")
    history = BatchHistory(spark)
    for b in by_batch(block_rows(table(spark, sf, "cas_block")), path):
        history.accept(spark.read.schema("ingest_id bigint, f binary, batch_id int").option("basePath", path).parquet(f"{path}/batch_id={b}"))
    return history


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p1(spark, sf).pairs()


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row an ingest: its class of equal ingests and how many of other batches repeat or nearly repeat it."""
    return _p1(spark, sf).classes()


def p1_duplicate_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_blocks(table(spark, sf, "cas_block"))


def p1_corrected_stats(spark: SparkSession, sf: str) -> DataFrame:
    """(ingest_id, reported, duplicate_blocks, differs) of every ingest that reported; null reports differ, repeated reports count once."""
    stats = table(spark, sf, "ingest_stats").where("ingest_id is not null").select("ingest_id", F.col("duplicate_blocks").alias("reported")).distinct()
    j = stats.join(p1_duplicate_blocks(spark, sf), "ingest_id")
    return j.select("ingest_id", "reported", "duplicate_blocks", (~F.col("reported").eqNullSafe(F.col("duplicate_blocks"))).alias("differs"))


P1_SQL = f"""with s as (select ingest_id, min(batch_id) b, {I.sql_digest("digest")} d from cas_block where digest is not null and ingest_id is not null group by 1, 3),
n as (select ingest_id, count(*) n, min(b) b from s group by 1),
c as (select x.ingest_id ingest_a, y.ingest_id ingest_b, count(*) k from s x join s y on x.d = y.d and x.ingest_id < y.ingest_id group by 1, 2)
select ingest_a, ingest_b from c join n p on p.ingest_id = ingest_a join n q on q.ingest_id = ingest_b where p.b <> q.b and 10 * k >= 7 * (p.n + q.n - k)"""
P1_CLASSES_SQL = f"""with p as ({P1_SQL}), l as (select i, count(*) k from (select ingest_a i from p union all select ingest_b from p) group by 1),
e as (select ingest_id, min(batch_id) batch_id, list_sort(list(distinct {I.sql_digest("digest")})) s from cas_block where digest is not null and ingest_id is not null group by 1)
select ingest_id, batch_id, min(ingest_id) over (partition by s) class_id, count(*) over (partition by s) members, coalesce(k, 0) links from e left join l on i = ingest_id"""
P1_BLOCKS_SQL = f"""with b as (select ingest_id, block_index, min(batch_id) batch_id, min({I.sql_digest("digest")}) d from cas_block where ingest_id is not null group by 1, 2),
r as (select *, row_number() over (partition by d order by batch_id, ingest_id, block_index) k from b)
select ingest_id, count(*) blocks, count(case when d is not null and k > 1 then 1 end) duplicate_blocks from r group by 1"""


# ---- p3: has this key been seen before ----
def _p3(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    known = table(spark, sf, "stored_block").select(I.valid_key_text(F.col("key")).alias("key"))
    batch = table(spark, sf, "key_bits").select("record_id", I.valid_block_key(F.col("algo"), F.col("digest"), F.col("size_bytes")).alias("key"))
    return SeenKeys(spark, known).check(batch)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p3(spark, sf)[0]


def p3_measured_error(spark: SparkSession, sf: str) -> DataFrame:
    return error_report(_p3(spark, sf)[1])


_VALID = "'(sha-1:[0-9a-f]{40}|(sha-256|blake3):[0-9a-f]{64}):[0-9]+'"
P3_SQL = f"""with s as (select distinct {I.sql_block_key("key")} k from stored_block where key is not null),
r as (select record_id, {I.sql_algorithm("algo")} || ':' || {I.sql_digest("digest")} || ':' || size_bytes k from key_bits),
v as (select record_id, k, min(record_id) over (partition by k) f from r where regexp_full_match(k, {_VALID}))
select record_id from v where record_id > f or k in (select k from s where k is not null)"""

# ---- p5: chunks into containers ----
CONTAINER = 4_194_304


def _p5(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "blob_data"), ["key", "chunk_offset"], "chunk_size", CONTAINER)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p5(spark, sf).where("pieces > 1 and piece = 0").select(F.lower(F.hex("key")).alias("key_hex"), "chunk_offset").distinct()


def p5_containers(spark: SparkSession, sf: str) -> DataFrame:
    p = _p5(spark, sf)
    return p.select(F.lower(F.hex("key")).alias("key_hex"), *p.columns[1:])


def p5_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill_report(_p5(spark, sf), CONTAINER)


P5_SQL = "select distinct lower(hex(key)) key_hex, chunk_offset from blob_data where chunk_size > 4194304"



# ---- p7: evaluation passages in documents ----
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    return leak_report(p7_found(spark, sf), table(spark, sf, "eval_items"))


# ---- p8: sources mixed to target shares ----
def p8_drawn(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"), table(spark, sf, "source_targets"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"), table(spark, sf, "source_targets"))[1]


# ---- p9: reading level ----
def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    return levels(table(spark, sf, "documents"), table(spark, sf, "level_labels"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_levels(spark, sf).where("level >= 4").select("doc_id")


def p9_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile(p9_levels(spark, sf))


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p1_duplicate_blocks": p1_duplicate_blocks,
    "p1_corrected_stats": p1_corrected_stats,
    "p3_found": p3_found,
    "p3_measured_error": p3_measured_error,
    "p5_found": p5_found,
    "p5_containers": p5_containers,
    "p5_fill": p5_fill,
    "p7_found": p7_found,
    "p7_leaked_items": p7_leaked_items,
    "p8_drawn": p8_drawn,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_levels": p9_levels,
    "p9_profile": p9_profile,
}
SQL = {
    "p1_found": P1_SQL,
    "p1_classes": P1_CLASSES_SQL,
    "p1_duplicate_blocks": P1_BLOCKS_SQL,
    "p1_corrected_stats": f"select s.ingest_id, s.reported, b.duplicate_blocks, s.reported is distinct from b.duplicate_blocks as differs from (select distinct ingest_id, duplicate_blocks reported from ingest_stats where ingest_id is not null) s join ({P1_BLOCKS_SQL}) b using (ingest_id)",
    "p3_found": P3_SQL,
    "p5_found": P5_SQL,
}
