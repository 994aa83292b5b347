"""Relational catalog: read plans, top rows, upserts, paging, search, duplicates, change feeds and constraints."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.functions.checks import parse_check  # noqa: F401 - part of the catalog's interface


# ---- locations and read plans ----
def active_locations(locations: DataFrame, sectors: DataFrame, stores: DataFrame) -> DataFrame:
    """Present locations in active sectors of active stores. The two dimensions are joined as they come: Spark broadcasts them only
    below its size threshold."""
    s = sectors.where("status = 'active'").select("sector_id", "store_id", F.col("priority").alias("sector_priority"))
    b = stores.where("status = 'active'").select("store_id", "store_type")
    return locations.where("status = 'present'").join(s, "sector_id").join(b, "store_id")


def best_first(tie: Sequence[str]) -> list[Column]:
    return [F.asc("sector_priority"), F.desc_nulls_last("verified_at"), F.desc("written_at"), *[F.asc(t) for t in tie]]


def best_locations(active: DataFrame, block: Sequence[str], tie: Sequence[str], limit: int = 5) -> DataFrame:
    """The ``limit`` best locations of each block, ranked from 1; none if the limit isn't positive."""
    w = Window.partitionBy(*block).orderBy(*best_first(tie))
    return active.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(0, limit))


def best_location(active: DataFrame, block: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per block (DISTINCT ON): the smallest of a struct ordered like :func:`best_first`, so it combines on the map side.
    ``columns`` break ties and come back."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rank = F.struct("sector_priority", F.col("verified_at").isNull().alias("n"), (-us("verified_at")).alias("v"), (-us("written_at")).alias("w"), *columns)
    return active.groupBy(*block).agg(F.min(rank).alias("__b")).select(*block, F.col("__b.sector_priority").alias("sector_priority"), *[F.col(f"__b.{c}").alias(c) for c in columns])


def read_plan(manifest: DataFrame, active: DataFrame, block: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every manifest entry with its best location, null where there is none. The best are found once per block, not per entry."""
    return manifest.join(best_location(active, block, columns), list(block), "left")


def top_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


# ---- changes ----
def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """DO UPDATE: a row of ``changes`` (unique on the keys) replaces that of ``base``; ``version`` then grows by one, new rows start at 1."""
    cols = [c for c in base.columns if c not in keys and c != version]
    c = changes.select(*keys, F.lit(True).alias("__new"), *[F.col(x).alias(f"__{x}") for x in cols])
    j = base.withColumn("__old", F.lit(True)).join(c, list(keys), "full")
    out = [*keys, *[F.when(F.col("__new"), F.col(f"__{x}")).otherwise(F.col(x)).alias(x) for x in cols]]
    if version:
        out.append(F.when(F.col("__old").isNull(), F.lit(1)).when(F.col("__new"), F.col(version) + 1).otherwise(F.col(version)).cast(base.schema[version].dataType).alias(version))
    return j.select(*out).select(*base.columns)


def insert_new(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DO NOTHING: only rows whose keys are new are added."""
    return base.unionByName(rows.join(base.select(*keys), list(keys), "left_anti").select(*base.columns))


def replace_group(base: DataFrame, rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Delete and insert again: all rows of the groups that occur in ``rows`` are replaced by them."""
    return base.join(rows.select(*group).distinct(), list(group), "left_anti").unionByName(rows.select(*base.columns))


def change_feed(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., op, row) between two snapshots: INSERT, UPDATE or DELETE with the row as JSON (of a deleted row the old one)."""
    cols = [c for c in before.columns if c not in keys]
    side = lambda d, p: d.select(*keys, F.struct(*[F.col(k) for k in keys], *cols).alias(p))
    j = side(before, "__b").join(side(after, "__a"), list(keys), "full")
    op = F.when(F.col("__b").isNull(), "INSERT").when(F.col("__a").isNull(), "DELETE").when(~F.col("__a").eqNullSafe(F.col("__b")), "UPDATE")
    return j.withColumn("op", op).where("op is not null").select(*keys, "op", F.to_json(F.coalesce("__a", "__b")).alias("row"))


def numbered(df: DataFrame, part: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with an ordinal from 0 in a declared order, as a streamed insert gives them."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("bigint") - 1)


def natural_id(*parts: Column) -> Column:
    """A repeatable UUID-shaped id of a natural key."""
    h = F.md5(F.to_json(F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


# ---- reading ----
def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page with ``total``, the number of all rows (counted by aggregation, not in a one-partition window)."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset(max(0, offset)).limit(max(0, limit)).withColumn("total", total)


def keyset_page(df: DataFrame, key: str, after: object | None, size: int) -> DataFrame:
    d = df if after is None else df.where(F.col(key) > F.lit(after))
    return d.orderBy(key).limit(max(0, size))


def own_rows(df: DataFrame, org: str, column: str = "org_id", shared: bool = False) -> DataFrame:
    """Row-level security: only the organisation's rows; ``shared`` also lets through rows of none."""
    own = F.col(column) == F.lit(org)
    return df.where(own | F.col(column).isNull() if shared else own)


FIELDS = {"hash": "blob_hash", "content_type": "content_type", "size": "size_bytes", "created": "created_at", "namespace": "namespace", "title": "title"}


@dataclass(frozen=True)
class Filter:
    """field op value; op is =, !=, <, <=, >, >=, prefix or contains. Field ``meta:<key>`` looks into the map ``metadata``."""

    field: str
    op: str
    value: object

    def column(self) -> Column:
        c = F.col("metadata")[self.field[5:]] if self.field.startswith("meta:") else F.col(FIELDS[self.field])
        v = F.lit(self.value)
        return {
            "=": lambda: c == v,
            "!=": lambda: c != v,
            "<": lambda: c < v,
            "<=": lambda: c <= v,
            ">": lambda: c > v,
            ">=": lambda: c >= v,
            "prefix": lambda: c.startswith(v),
            "contains": lambda: F.contains(F.lower(c), F.lower(v)),
        }[self.op]()


def size_range(lo: int | None, hi: int | None) -> list[Filter]:
    return [Filter("size", op, v) for op, v in ((">=", lo), ("<=", hi)) if v is not None]


def search(df: DataFrame, filters: Sequence[Filter] = (), any_of: Sequence[Sequence[Filter]] = (), text: str | None = None, tags: Sequence[str] = (), after: object | None = None, size: int | None = None, key: str = "document_id") -> DataFrame:
    """All filters, at least one filter of every group of ``any_of``, the text in title or namespace, any of the tags, one page.
    Several = filters on one field are alternatives."""
    same: dict[str, list[object]] = {}
    for f in filters:
        if f.op == "=":
            same.setdefault(f.field, []).append(f.value)
    cond = F.lit(True)
    for f in filters:
        if f.op != "=":
            cond = cond & f.column()
    for field, values in same.items():
        one = F.lit(False)
        for v in values:
            one = one | Filter(field, "=", v).column()
        cond = cond & one
    for group in any_of:
        one = F.lit(False)
        for f in group:
            one = one | f.column()
        cond = cond & one
    if text:
        cond = cond & (F.contains(F.lower("title"), F.lit(text.lower())) | F.contains(F.lower("namespace"), F.lit(text.lower())))
    if tags:
        cond = cond & F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))
    d = df.where(cond)
    return d if size is None else keyset_page(d, key, after, size)


def find_duplicates(df: DataFrame, hash_prefix: str = "", size: int | None = None) -> DataFrame:
    """(blob_hash, size_bytes, copies, first_document, last_document) of hashes held by more than one document."""
    d = df.where(F.col("blob_hash").startswith(hash_prefix))
    d = d if size is None else d.where(F.col("size_bytes") == size)
    g = d.groupBy("blob_hash", "size_bytes").agg(F.count(F.lit(1)).alias("copies"), F.min("document_id").alias("first_document"), F.max("document_id").alias("last_document"))
    return g.where("copies > 1")


def system_stats(blocks: DataFrame, key: str = "block_key", size: str = "size") -> DataFrame:
    """(total_blocks, total_bytes, unique_blocks, unique_bytes, duplicate_ratio)"""
    per = blocks.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(size).cast("bigint").alias("s"))
    g = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_blocks"), F.coalesce(F.sum(F.col("n") * F.col("s")), F.lit(0)).alias("total_bytes"), F.count(F.lit(1)).alias("unique_blocks"), F.coalesce(F.sum("s"), F.lit(0)).alias("unique_bytes")
    )
    return g.withColumn("duplicate_ratio", F.coalesce(F.try_divide(F.col("total_blocks") - F.col("unique_blocks"), F.col("total_blocks")), F.lit(0.0)))


def newest(df: DataFrame, at: str, tie: str, n: int = 20) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(at), F.desc(tie)).limit(n)


def export(manifest: DataFrame, blocks: DataFrame, blobs: DataFrame, blob: str, data: str = "block", key: str = "block_key") -> DataFrame:
    """(blob, ordinal, start, end, block_key, data) of the chosen blobs, in no particular order of rows."""
    return manifest.join(blobs.select(blob).distinct(), blob, "left_semi").join(blocks.select(key, data).dropDuplicates([key]), key, "left")


def overlapping_spans(spans: DataFrame, key: Sequence[str], width: int = 1 << 22) -> DataFrame:
    """Pairs that an exclusion constraint on (key, span) forbids: (key..., a, b, ...) with ordinals a < b. Spans are binned, no nested loop."""
    b = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    l, r = (b.select(*key, "__bin", F.col("ordinal").alias(x), F.col("start").alias(f"{x}_start"), F.col("end").alias(f"{x}_end")) for x in "ab")  # noqa: E741
    j = l.join(r, [*key, "__bin"]).where("a < b and a_start <= b_end and b_start <= a_end")
    return j.where(F.col("__bin") == F.floor(F.greatest("a_start", "b_start") / width)).drop("__bin")


def ancestors(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(child, root, depth): each child with the last element of its chain of parents, the longest where a child has several parents (of
    equally long ones the largest root). A chain that runs into a cycle has no last element: its root and depth are null.

    Pointer doubling on written tables: the pairs 2^k steps apart give those 2^(k+1) apart until there are none, then each child goes up
    by the largest steps that it can. The number of rounds grows with the logarithm of the longest chain; a walk of more steps than
    there are children has met one of them twice.
    """
    from blockloom.workspace import written

    jumps = [written(edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).distinct(), "jumps")]
    children = jumps[0].select("c").distinct().count()
    up = lambda d, j: d.join(j.select(F.col("c").alias("p"), F.col("p").alias("q")), "p")
    while more := jumps[-1].limit(1).count():
        if 1 << (len(jumps) - 1) > children:
            break
        jumps.append(written(up(jumps[-1], jumps[-1]).select("c", F.col("q").alias("p")).distinct(), "jumps"))
    endless = (jumps[-1] if more else jumps[-1].limit(0)).select(F.col("c").alias("e")).distinct()
    at = jumps[0].withColumn("depth", F.lit(1).cast("bigint")).join(endless, F.col("c").eqNullSafe(F.col("e")), "left_anti")
    for k in range(len(jumps) - 2, -1, -1):
        higher = up(at, jumps[k]).select("c", F.col("q").alias("p"), (F.col("depth") + (1 << k)).alias("depth")).distinct()
        at = written(at.join(higher.select(F.col("c").alias("h")).distinct(), F.col("c").eqNullSafe(F.col("h")), "left_anti").unionByName(higher), "heights")
    found = at.groupBy("c").agg(F.max("p").alias("root"), F.max("depth").cast("int").alias("depth"))
    found = found.unionByName(endless.select(F.col("e").alias("c"), F.lit(None).cast(edges.schema[parent].dataType).alias("root"), F.lit(None).cast("int").alias("depth")))
    return found.select(F.col("c").alias(child), "root", "depth")


# ---- schemas and constraints ----
def schema_graph(schema: T.StructType, name: str = "root") -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str]]]:
    """(nodes, edges): nodes (path, kind, type) of kind Product, Collection, Optional, Primitive or Opaque; edges (from, to, label)."""
    nodes: list[tuple[str, str, str]] = []
    edges: list[tuple[str, str, str]] = []

    def walk(path: str, t: T.DataType, nullable: bool) -> str:
        if nullable:
            inner = walk(path + "?", t, False)
            nodes.append((path, "Optional", t.simpleString()))
            edges.append((path, inner, "value"))
            return path
        if isinstance(t, T.StructType):
            nodes.append((path, "Product", "struct"))
            for f in t.fields:
                edges.append((path, walk(f"{path}.{f.name}", f.dataType, f.nullable), f.name))
        elif isinstance(t, T.ArrayType):
            nodes.append((path, "Collection", "array"))
            edges.append((path, walk(path + "[]", t.elementType, t.containsNull), "element"))
        elif isinstance(t, T.MapType):
            nodes.append((path, "Collection", "map"))
            edges.append((path, walk(path + "{key}", t.keyType, False), "key"))
            edges.append((path, walk(path + "{value}", t.valueType, t.valueContainsNull), "value"))
        else:
            nodes.append((path, "Opaque" if isinstance(t, (T.UserDefinedType, T.NullType)) else "Primitive", t.simpleString()))
        return path

    walk(name, schema, False)
    return nodes, edges


def describe(df: DataFrame, table: str) -> DataFrame:
    """(table_name, ordinal, column_name, type, nullable): the typed schema of a table as rows."""
    rows = [(table, i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "table_name string, ordinal int, column_name string, type string, nullable boolean")


# ---- jobs, ids, partitions ----
def runnable_jobs(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    """Queued jobs that are due and not leased, oldest first: what a worker may claim."""
    free = F.col("lease_until").isNull() | (F.col("lease_until") < now)
    return jobs.where((F.col("status") == "queued") & (F.col("run_at") <= now) & free).orderBy("run_at", "job_id").limit(max(0, limit))


def queued_count(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'queued'").agg(F.count(F.lit(1)).alias("queued"))


def next_audit(audit: DataFrame, part: Sequence[str], seq: str, row_hash: str) -> DataFrame:
    """(part..., next_seq, prev_hash) for the next record of each chain."""
    return audit.where(F.col(seq).isNotNull()).groupBy(*part).agg((F.max(seq) + 1).alias("next_seq"), F.max_by(row_hash, seq).alias("prev_hash"))


def locator_canonical(scheme: Column, bucket: Column, path: Column) -> Column:
    """The generated column of a location: missing parts are empty."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(e(scheme), F.lit("://"), e(bucket), F.lit("/"), F.regexp_replace(e(path), "^/+", ""))


def locator_ok(kind: Column, locator_json: Column) -> Column:
    """The contract of a location by its kind: an s3 location has bucket and key, a file location an absolute path."""
    get = lambda k: F.get_json_object(locator_json, f"$.{k}")
    return F.coalesce(F.when(kind == "s3", get("bucket").isNotNull() & get("key").isNotNull()).when(kind == "file", get("path").rlike("^/")).otherwise(F.lit(False)), F.lit(False))


def head(blobs: DataFrame, key: str, inline: str, size: str) -> DataFrame:
    """(key, size, inline): whether a blob's bytes lie in its row, without reading them out."""
    return blobs.select(key, size, F.col(inline).isNotNull().alias("inline"))


def partitioned(df: DataFrame, column: str, parts: int = 16) -> DataFrame:
    """Rows with ``part``, the hash partition of ``column``; write with ``partitionBy("part")`` to prune by it. Hot values are spread
    inside their partition by Spark's task splitting."""
    return df.withColumn("part", F.pmod(F.xxhash64(column), F.lit(parts)).cast("int"))


def subscribe(events: DataFrame, topics: Sequence[str], topic: str = "topic") -> DataFrame:
    """The events of some topics; works on streams too."""
    return events.where(F.col(topic).isin(list(topics)))
