"""Queries on the store's own tables: copies that differ (p2), orphan references (p4), totals per organisation (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import identity as I
from blockloom.operators.dense import dense_totals
from blockloom.operators.diff import diff
from blockloom.operators.orphans import orphans, parent_summary, reference_summary
from blockloom.workspace import table, written

# ---- p2: replica against replica_mirror ----
#: what may stand around an etag's value
ETAG_DRESS = r"""^[\s"']*(?:w/)?[\s"']*|[\s"']+$"""
REPLICA_KEY = ("algo_id", "hash", "store_key")


def _replica_fields() -> dict:
    etag = F.regexp_replace(F.lower("etag"), ETAG_DRESS, "")
    return {
        "size_bytes": F.col("size_bytes"),
        "etag": F.nullif(etag, F.lit("")),
        "status": F.lower("status"),
        "storage_class": F.lower("storage_class"),
    }


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    d = diff(
        table(spark, sf, "replica"),
        table(spark, sf, "replica_mirror"),
        REPLICA_KEY,
        _replica_fields(),
        version="last_verified_at",
        only_left="missing_in_mirror",
        only_right="missing_in_replica",
    )
    return d.select("algo_id", I.hex_lower(F.col("hash")).alias("hash_hex"), I.hex_lower(F.col("store_key")).alias("store_key_hex"), "finding")


def p2_summary(spark: SparkSession, sf: str) -> DataFrame:
    return p2_found(spark, sf).groupBy("finding", "algo_id").agg(F.count(F.lit(1)).alias("n_keys"))


_DRESS = ETAG_DRESS.replace("'", "''")
_P2_SIDE = f"""select algo_id, hash, store_key, size_bytes, etag, status, storage_class from (
  select algo_id, hash, store_key, size_bytes, nullif(regexp_replace(lower(etag), '{_DRESS}', '', 'g'), '') etag,
    lower(status) status, lower(storage_class) storage_class, last_verified_at v from {{t}}
  where algo_id is not null and hash is not null and store_key is not null)
  qualify row_number() over (partition by algo_id, hash, store_key order by v desc nulls last, size_bytes desc nulls last,
    etag desc nulls last, status desc nulls last, storage_class desc nulls last) = 1"""
P2_SQL = f"""with a as ({_P2_SIDE.format(t="replica")}), b as ({_P2_SIDE.format(t="replica_mirror")}),
j as (select algo_id, lower(hex(hash)) hash_hex, lower(hex(store_key)) store_key_hex, a.algo_id is not null in_a, b.algo_id is not null in_b,
  a.size_bytes s1, b.size_bytes s2, a.etag e1, b.etag e2, a.status t1, b.status t2, a.storage_class c1, b.storage_class c2
  from (select *, 1 x from a) a full join (select *, 1 x from b) b using (algo_id, hash, store_key)),
k as (select j.* replace (x1 as in_a, x2 as in_b) from (select *, in_a x1, in_b x2 from j) j)
select algo_id, hash_hex, store_key_hex, finding from (
  select algo_id, hash_hex, store_key_hex, 'missing_in_mirror' finding from k where not in_b
  union all select algo_id, hash_hex, store_key_hex, 'missing_in_replica' from k where not in_a
  union all select algo_id, hash_hex, store_key_hex, 'size_bytes' from k where in_a and in_b and s1 is distinct from s2
  union all select algo_id, hash_hex, store_key_hex, 'etag' from k where in_a and in_b and e1 is distinct from e2
  union all select algo_id, hash_hex, store_key_hex, 'status' from k where in_a and in_b and t1 is distinct from t2
  union all select algo_id, hash_hex, store_key_hex, 'storage_class' from k where in_a and in_b and c1 is distinct from c2)"""


# ---- p4: references to blobs and stored blocks that don't hold ----
def _orphan_rows(spark: SparkSession, sf: str) -> DataFrame:
    blobs = parent_summary(table(spark, sf, "blobs"), "key", "created_at", "deleted_at")
    to_blobs = {t: reference_summary(table(spark, sf, t), "key", "created_at") for t in ("manifests", "blob_data")}
    stored = table(spark, sf, "stored_block").select(I.block_key(F.col("key")).alias("key"), "stored_at", "removed_at")
    entries = table(spark, sf, "block_manifest_entry").select(I.block_key(F.col("key")).alias("key"), "created_at")
    a = orphans(to_blobs, blobs).withColumn("ref_key", I.hex_lower(F.col("key")))
    b = orphans({"block_manifest_entry": reference_summary(entries, "key", "created_at")}, parent_summary(stored, "key", "stored_at", "removed_at"))
    return a.drop("key").unionByName(b.withColumnRenamed("key", "ref_key"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphan_rows(spark, sf).select("table_name", "ref_month", "ref_key", "reason")


def p4_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return _orphan_rows(spark, sf).groupBy("table_name", "ref_month", "reason").agg(F.count(F.lit(1)).alias("n_keys"))


_P4_PART = """select distinct '{t}' table_name, strftime(r.created_at, '%Y-%m') ref_month, {show} ref_key,
  case when p.k is null then 'missing' when p.d then 'deleted' when p.c > r.created_at then 'late' end reason
  from (select {rk} k, created_at from {t}) r left join (select {pk} k, min(case when {dead} is not null then 1 else 0 end) = 1 d, min({born}) c
  from {p} where key is not null group by 1) p using (k) where r.k is not null"""
P4_SQL = (
    "select * from ("
    + " union all ".join(
        [_P4_PART.format(t=t, show="lower(hex(r.k))", rk="key", pk="key", p="blobs", dead="deleted_at", born="created_at") for t in ("manifests", "blob_data")]
        + [
            _P4_PART.format(
                t="block_manifest_entry", show="r.k", rk=I.sql_block_key("key"), pk=I.sql_block_key("key"), p="stored_block", dead="removed_at", born="stored_at"
            )
        ]
    )
    + ") where reason is not null"
)


# ---- p6: totals per organisation although few hold most rows ----
def p6_per_org(spark: SparkSession, sf: str) -> DataFrame:
    a = dense_totals(table(spark, sf, "audit_record"), "org_id", F.col("byte_count"), F.col("ts"), I.org)
    d = dense_totals(table(spark, sf, "documents"), "org_id", F.col("n_chars"), F.col("created_at"), I.org)
    both = a.withColumn("table_name", F.lit("audit_record")).unionByName(d.withColumn("table_name", F.lit("documents")))
    return both.select("table_name", F.col("key").alias("org_id"), "n_rows", "n_bytes", F.col("last_at").cast("timestamp_ntz").alias("last_at"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    per_org = written(p6_per_org(spark, sf), "per-org")
    total = per_org.groupBy("table_name").agg(F.sum("n_rows").alias("total"))
    return per_org.join(F.broadcast(total), "table_name").where("org_id is not null and n_rows * 50 >= total").select("table_name", "org_id")


_P6_PART = """select '{t}' table_name, {org} org_id, count(*) n_rows, coalesce(sum({b}), 0)::bigint n_bytes, max({at}) last_at from {t} group by 2"""
P6_SQL = " union all ".join(
    _P6_PART.format(t=t, org=I.sql_org("org_id"), b=b, at=at) for t, b, at in (("audit_record", "byte_count", "ts"), ("documents", "n_chars", "created_at"))
)

QUERIES = {"p2_found": p2_found, "p2_summary": p2_summary, "p4_found": p4_found, "p4_by_month": p4_by_month, "p6_found": p6_found, "p6_per_org": p6_per_org}
SQL = {
    "p2_found": P2_SQL,
    "p2_summary": f"select finding, algo_id, count(*) n_keys from ({P2_SQL}) group by 1, 2",
    "p4_found": P4_SQL,
    "p4_by_month": f"select table_name, ref_month, reason, count(*) n_keys from ({P4_SQL}) group by 1, 2, 3",
    "p6_found": f"select table_name, org_id from (select *, sum(n_rows) over (partition by table_name) total from ({P6_SQL})) where org_id is not null and n_rows * 50 >= total",
    "p6_per_org": P6_SQL,
}
