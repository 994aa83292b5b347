"""Keys, ranges, manifests, the relational catalog and governance over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import codecs as K
from blockloom.functions import digests as D
from blockloom.functions import identity as I
from blockloom.operators import catalog as C
from blockloom.operators import chunking, govern, store
from blockloom.operators import ranges as R
from blockloom.plans.stream_queries import B256
from blockloom.workspace import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# ---- keys and digests ----
@query("select doc_id, sha256(text) as sha256, sha1(text) as sha1, octet_length(encode(text))::bigint as size from documents where text is not null")
def key_multi_hash(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").withColumn("b", F.encode("text", "UTF-8"))
    return d.withColumn("h", D.multi_hash(F.col("b"))).select("doc_id", "h.sha256", "h.sha1", F.octet_length("b").cast("bigint").alias("size"))


@query("select record_id, case when regexp_full_match(digest, '[0-9a-fA-F]{64}') then lower(digest) else sha256(digest) end as digest, length(digest) as size from key_bits where digest is not null")
def key_hex_or_text(spark, sf):
    d = table(spark, sf, "key_bits").where("digest is not null").withColumn("h", D.hex_or_text(F.col("digest")))
    return d.select("record_id", "h.digest", "h.size")


@query(f"with k as (select {I.sql_block_key('key')} k, stored_at from stored_block) select k as block_key, split_part(k, ':', 1) as algo, split_part(k, ':', 2) as digest, split_part(k, ':', 3)::bigint as size, stored_at from k where regexp_full_match(k, '(sha-1:[0-9a-f]{{40}}|(sha-256|blake3):[0-9a-f]{{64}}):[0-9]+')")
def key_parse(spark, sf):
    d = table(spark, sf, "stored_block").select(I.block_key(F.col("key")).alias("block_key"), D.parse_key(F.col("key")).alias("k"), "stored_at")
    return d.where("k is not null").select("block_key", "k.algo", "k.digest", "k.size", "stored_at")


@query(f"with k as (select distinct {I.sql_block_key('key')} k from stored_block where key is not null), p as (select k, split_part(k, ':', 1) a, split_part(k, ':', 2) d, split_part(k, ':', 3) s from k) select k as block_key, 'cas/' || d[1:2] || '/' || d[3:4] || '/' || d as locator, 'cas/blocks/' || a || '/' || d || '-' || s as path, 's3://bucket/' || d as uri from p")
def key_locator(spark, sf):
    d = table(spark, sf, "stored_block").where("key is not null").select(I.block_key(F.col("key")).alias("block_key")).distinct()
    k = F.split("block_key", ":")
    return d.select("block_key", D.locator(k[1]).alias("locator"), D.block_path(k[0], k[1], k[2]).alias("path"), D.render_locator(F.lit("s3"), F.lit("bucket"), k[1]).alias("uri"))


@query("select algo_id, lower(hex(hash)) as hash_hex, lower(hex(store_key)) as store_hex, size_bytes, coalesce(size_bytes between 1 and 1000000, false) as valid from replica where size_bytes is null or size_bytes > 0")
def key_refined(spark, sf):
    d = table(spark, sf, "replica").where("size_bytes is null or size_bytes > 0")
    ok, bad = D.refined(d, {"size": F.col("size_bytes").between(1, 1000000)})
    both = ok.withColumn("valid", F.lit(True)).unionByName(bad.drop("violations").withColumn("valid", F.lit(False)))
    return both.select("algo_id", I.hex_lower(F.col("hash")).alias("hash_hex"), I.hex_lower(F.col("store_key")).alias("store_hex"), "size_bytes", "valid")


@query("select ingest_id, block_index, size_bytes, case when size_bytes::bigint + 16000000 between 1 and 16777216 then size_bytes::bigint + 16000000 end as checked, case when size_bytes::bigint * 2 between 1 and 16777216 then size_bytes::bigint * 2 else size_bytes end as saturated from cas_block")
def key_arithmetic(spark, sf):
    s = F.col("size_bytes").cast("bigint")
    d = table(spark, sf, "cas_block")
    return d.select("ingest_id", "block_index", "size_bytes", D.checked("add", s, F.lit(16000000).cast("bigint"), "block_size").alias("checked"), D.saturating("mul", s, F.lit(2).cast("bigint"), "block_size").alias("saturated"))


@query(f"with k as (select distinct {I.sql_digest('digest')} d from cas_block where digest is not null) select d as digest, 'sha-256:' || sha256(encode('blockloom:view:v1') || unhex('01' || '00000007' || hex(encode('sha-256')) || '00000020' || d || '0000000000000400') || unhex('01' || '00000005' || hex(encode('thumb')) || '01' || '00000003' || hex(encode('all')) || '00000001' || '00000001' || hex(encode('w')) || '00000002' || hex(encode('64')))) || ':0' as view_key, true as deterministic from k where regexp_full_match(d, '[0-9a-f]{{64}}')")
def key_view(spark, sf):
    d = table(spark, sf, "cas_block").where("digest is not null").select(I.digest(F.col("digest")).alias("digest")).distinct().where(F.col("digest").rlike("^[0-9a-f]{64}$"))
    args = F.create_map(F.lit("w"), F.lit("64"))
    return d.select("digest", D.view_key(F.lit("sha-256"), F.col("digest"), F.lit(1024).cast("bigint"), F.lit("thumb"), args, F.lit("all")).alias("view_key"), D.deterministic_args(args).alias("deterministic"))


@query("select lower(hex(key)) as key_hex, json_extract_string(attributes, '$.origin') as origin, try_cast(json_extract_string(attributes, '$.retain_days') as bigint) as retain_days, row_version from blobs")
def key_json_attributes(spark, sf):
    a = F.from_json("attributes", "origin string, retain_days bigint")
    return table(spark, sf, "blobs").select(I.hex_lower(F.col("key")).alias("key_hex"), a["origin"].alias("origin"), a["retain_days"].alias("retain_days"), "row_version")


@query("select doc_id, octet_length(encode(text)) // 3 as records, octet_length(encode(text)) % 3 as left_over from documents where text <> ''")
def codec_fixed_records(spark, sf):
    d = table(spark, sf, "documents").where("text <> ''")
    out = K.decoded(d, ["doc_id"], "text", lambda b: (lambda r: [*r[0], r[1]])(K.fixed_records([b], 3)))
    return out.select("doc_id", (F.size("parts") - 1).cast("bigint").alias("records"), F.octet_length(F.element_at("parts", -1)).cast("bigint").alias("left_over"))


@query("select doc_id, sha256(text) as digest, null::varchar as error from documents where text <> ''")
def codec_http_chunked(spark, sf):
    """Each text as a chunked body of two chunks, decoded again."""
    d = table(spark, sf, "documents").where("text <> ''").withColumn("b", F.encode("text", "UTF-8"))
    half = F.ceil(F.octet_length("b") / 2).cast("int")
    crlf = F.lit(bytearray(b"\r\n"))
    line = lambda n: F.encode(F.concat(F.lower(F.hex(n.cast("bigint"))), F.lit(";x=1")), "UTF-8")
    rest = F.octet_length("b") - half
    second = F.when(rest > 0, F.concat(line(rest), crlf, F.substring(F.col("b"), half + 1, rest), crlf)).otherwise(F.lit(bytearray(b"")))
    body = F.concat(line(half), crlf, F.substring(F.col("b"), F.lit(1), half), crlf, second, F.lit(bytearray(b"0\r\nA: b\r\n\r\n")))
    out = K.decoded(d.select("doc_id", body.alias("body")), ["doc_id"], "body", K.http_chunks)
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p)), ""))
    return out.select("doc_id", F.sha2(whole, 256).alias("digest"), "error")


@query("select doc_id, sha256(text) as digest, octet_length(encode(text)) as size from documents where text <> ''")
def codec_block_frames(spark, sf):
    """Each text as two frames, written and read as one stream cut at odd places."""
    d = table(spark, sf, "documents").where("text <> ''")

    def there_and_back(b: bytes) -> list[bytes]:
        raw = b"".join(K.encode_frame(K.frame_block(p, block_index=i, org_id="o", extra=(("k", "v"),))) for i, p in enumerate((b[: len(b) // 2], b[len(b) // 2 :])))
        return [f.payload for f in K.decode_stream([raw[i : i + 977] for i in range(0, len(raw), 977)], K.decode_frame)]

    out = K.decoded(d, ["doc_id"], "text", there_and_back)
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p)), ""))
    return out.select("doc_id", F.sha2(whole, 256).alias("digest"), F.octet_length(whole).cast("bigint").alias("size"))


@query()
def codec_manifest_frames(spark, sf):
    blocks, manifest = _ingested(spark, sf)
    k = F.split("block_key", ":")
    e = manifest.select("doc_id", "ordinal", k[0].alias("algo"), k[1].alias("digest"), k[2].cast("bigint").alias("size"), "start", "end")
    return K.manifest_frames(e, "doc_id")


@query(f"select doc_id, 0 as page, 0::bigint as start, max(octet_length(encode(text)))::bigint - 1 as end, count(*)::int as entries, true as named from {B256} join documents using (doc_id) group by 1")
def codec_manifest_root(spark, sf):
    """Pages of manifests under a root, encoded and read back; each page's name is the hash of its frame."""
    blocks, manifest = _ingested(spark, sf)
    k = F.split("block_key", ":")
    e = manifest.select("doc_id", "ordinal", k[0].alias("algo"), k[1].alias("digest"), k[2].cast("bigint").alias("size"), "start", "end")
    frames = K.manifest_frames(e, "doc_id").select("doc_id", "page", "frame", "entries")
    pages = frames.join(store.paginate(manifest, "doc_id", K.MAX_ENTRIES).select("doc_id", F.col("page").cast("int").alias("page"), "start", "end"), ["doc_id", "page"])
    back = K.root_pages(K.manifest_roots(pages, "doc_id"), "doc_id")
    named = back.join(pages.select("doc_id", "page", F.sha2("frame", 256).alias("want")), ["doc_id", "page"])
    return named.select("doc_id", "page", "start", "end", "entries", (F.col("digest") == F.col("want")).alias("named"))


# ---- ranges: chunks of blobs, gaps between them ----
_PAIRS = "(select l_orderkey, l_linenumber, l_partkey st, l_partkey + 40 en, lag(l_partkey) over w ps, lag(l_partkey) over w + l_suppkey en2 from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey))"


@query(
    f"with p as (select *, st <= en2 and ps <= en as ov, en + 1 = ps or en2 + 1 = st as tou from {_PAIRS} where ps is not null) select l_orderkey, l_linenumber, ov as overlaps, tou as touches, case when ov or tou then least(st, ps) end as merged_start, case when ov or tou then greatest(en, en2) end as merged_end, case when ov then greatest(st, ps) end as both_start, case when ov then least(en, en2) end as both_end, "
    "case when ov then (st < ps)::int + (en > en2)::int else 1 end as rest_spans, case when ov then greatest(ps - st, 0) + greatest(en - en2, 0) else en - st + 1 end as rest_length from p"
)
def range_pairwise(spark, sf):
    """Each line's span against that of the line before: overlap, touch, merge, intersection and what is left."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.lag("l_partkey").over(w).alias("ps"), F.col("l_partkey").alias("st")).where("ps is not null")
    a, b = (F.col("st"), F.col("st") + 40), (F.col("ps"), F.col("ps") + F.col("l_suppkey"))
    rest, m, i = R.subtract(*a, *b), R.merge(*a, *b), R.intersection(*a, *b)
    length = F.aggregate(rest, F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"] + 1)
    return d.select(
        "l_orderkey", "l_linenumber", R.overlaps(*a, *b).alias("overlaps"), R.touches(*a, *b).alias("touches"), m["start"].alias("merged_start"), m["end"].alias("merged_end"), i["start"].alias("both_start"), i["end"].alias("both_end"), F.size(rest).alias("rest_spans"), length.alias("rest_length")
    )


_SPAN = "select lower(hex(key)) k, chunk_offset st, chunk_offset + chunk_size - 1 en from blob_data where chunk_size > 0"
_NORM = "(select k, min(st) st, max(en) en from (select *, sum(n) over (partition by k order by st, en rows unbounded preceding) i from (select *, case when max(en) over (partition by k order by st, en rows between unbounded preceding and 1 preceding) >= st - 1 then 0 else 1 end n from ({s}))) group by k, i)"


def _spans(spark, sf) -> DataFrame:
    d = table(spark, sf, "blob_data").where("chunk_size > 0")
    return d.select(I.hex_lower(F.col("key")).alias("k"), F.col("chunk_offset").alias("start"), (F.col("chunk_offset") + F.col("chunk_size") - 1).alias("end"))


def _entries(spark, sf) -> DataFrame:
    d = table(spark, sf, "block_manifest_entry").where("size_bytes > 0 and block_offset >= 0")
    return d.select(I.hex_lower(F.col("blob_key")).alias("k"), F.col("block_offset").alias("start"), (F.col("block_offset") + F.col("size_bytes") - 1).alias("end"))


_ENTRY = "select lower(hex(blob_key)) k, block_offset st, block_offset + size_bytes - 1 en from block_manifest_entry where size_bytes > 0 and block_offset >= 0"


@query(f"select k, st as start, en as end from {_NORM.format(s=_SPAN)}")
def range_normalize(spark, sf):
    return R.normalize(_spans(spark, sf), ["k"], slice_width=1 << 24)


@query(f"select k, st as start, en as end from {_NORM.format(s=_SPAN + ' union all ' + _ENTRY)}")
def range_union(spark, sf):
    return R.union(_spans(spark, sf), _entries(spark, sf), ["k"])


_A, _B = _NORM.format(s=_SPAN), _NORM.format(s=_ENTRY)


@query(f"select k, st as start, en as end from {_NORM.format(s=f'select a.k, greatest(a.st, b.st) st, least(a.en, b.en) en from {_A} a join {_B} b on a.k = b.k and a.st <= b.en and b.st <= a.en')}")
def range_intersect(spark, sf):
    return R.intersect(_spans(spark, sf), _entries(spark, sf), ["k"], slice_width=1 << 28)


_DIFF = "(with a as (select * from {a}), b as (select * from {b}), e as (select k, st pos, 1 da, 0 db from a union all select k, en + 1, -1, 0 from a union all select k, st, 0, 1 from b union all select k, en + 1, 0, -1 from b), g as (select k, pos, sum(da) da, sum(db) db from e group by 1, 2), r as (select k, pos, sum(da) over (partition by k order by pos) ina, sum(db) over (partition by k order by pos) inb, lead(pos) over (partition by k order by pos) nx from g) select k, pos st, nx - 1 en from r where ina > 0 and inb = 0)"


@query(f"select k, st as start, en as end from {_NORM.format(s='select * from ' + _DIFF.format(a=_A, b=_B))}")
def range_difference(spark, sf):
    return R.difference(_spans(spark, sf), _entries(spark, sf), ["k"])


_UNIVERSE = "(select lower(hex(key)) k, 0 st, max(size_bytes) - 1 en from blobs where size_bytes > 0 group by 1)"


def _universe(spark, sf) -> DataFrame:
    return table(spark, sf, "blobs").where("size_bytes > 0").groupBy(I.hex_lower(F.col("key")).alias("k")).agg(F.lit(0).cast("bigint").alias("start"), (F.max("size_bytes") - 1).alias("end"))


@query(f"select k, st as start, en as end from {_NORM.format(s='select * from ' + _DIFF.format(a=_UNIVERSE, b=_A))}")
def range_complement(spark, sf):
    return R.complement(_spans(spark, sf), _universe(spark, sf), ["k"])


@query(f"with p as (select k, unnest([0, (en - st) // 2, en]) v from {_UNIVERSE}) select p.k, p.v, max(case when s.k is not null then 1 else 0 end) = 1 as contained from (select distinct k, v from p) p left join {_A} s on p.k = s.k and p.v between s.st and s.en group by 1, 2")
def range_contains(spark, sf):
    u = _universe(spark, sf)
    v = u.select("k", F.explode(F.array(F.col("start"), F.floor((F.col("end") - F.col("start")) / 2), F.col("end"))).alias("v")).distinct()
    return R.contains_values(_spans(spark, sf), v, ["k"], "v", slice_width=1 << 26)


@query(f"select k, sum(en - st + 1)::bigint as covered from {_A} group by 1")
def range_covered(spark, sf):
    return R.covered_length(_spans(spark, sf), ["k"])


_WINDOW = "(select k, (en // 4)::bigint st, (en // 2)::bigint en from " + _UNIVERSE + " where en // 4 <= en // 2)"


@query(f"select k, st as start, en as end from {_NORM.format(s='select * from ' + _DIFF.format(a=_WINDOW, b=_A))}")
def range_missing_within(spark, sf):
    w = _universe(spark, sf).select("k", F.expr("end div 4").alias("start"), F.expr("end div 2").alias("end"))
    return R.missing_within(_spans(spark, sf), w, ["k"])


@query(f"with n as (select k, st, en, lead(st) over (partition by k order by st) nx, min(st) over (partition by k) lo from {_A}), g as (select k, en + 1 st, nx - 1 en from n where nx is not null union all select distinct k, 1000, lo - 1 from n where lo > 1000), c as (select k, greatest(st, 1000) st, en from g where en >= 1000) select k, min(st) as start, arg_min(en, st) as end from c group by 1")
def range_next_gap(spark, sf):
    return R.next_gap(_spans(spark, sf), ["k"], 1000)


@query("with b as (select lower(hex(key)) k, size_bytes n from blobs where size_bytes > 0), h as (select k, n, unnest(['bytes=0-99', 'bytes=1000-', 'bytes=-500', 'bytes=5-2', 'lines=1-2']) h from b), p as (select *, regexp_extract(h, '^bytes=(\\d*)-(\\d*)$', 1) a, regexp_extract(h, '^bytes=(\\d*)-(\\d*)$', 2) z from h), r as (select k, n, h, case when a <> '' then a::bigint else greatest(n - z::bigint, 0) end s, case when a <> '' and z <> '' then least(z::bigint, n - 1) else n - 1 end e from p where a <> '' or z <> '') select k, n, h as header, s as start, e as end from r where s <= e")
def range_http(spark, sf):
    b = table(spark, sf, "blobs").where("size_bytes > 0").select(I.hex_lower(F.col("key")).alias("k"), F.col("size_bytes").alias("n"))
    h = b.withColumn("header", F.explode(F.array(*[F.lit(x) for x in ("bytes=0-99", "bytes=1000-", "bytes=-500", "bytes=5-2", "lines=1-2")])))
    return h.withColumn("r", R.parse_http_range(F.col("header"), F.col("n"))).where("r is not null").select("k", "n", "header", "r.start", "r.end")


@query(f"select u.k, coalesce(c.covered, 0)::bigint as covered, u.en + 1 as total, coalesce(c.covered, 0) >= u.en + 1 as complete from {_UNIVERSE} u left join (select k, sum(en - st + 1) covered from {_A} group by 1) c using (k)")
def range_progress(spark, sf):
    t = _universe(spark, sf).select("k", (F.col("end") + 1).alias("total"))
    return R.progress(_spans(spark, sf), t, ["k"], "total").select("k", "covered", "total", "complete")


# ---- store ----
_PUT = f"(select *, row_number() over (partition by d order by doc_id, block_index) = 1 fresh from (select doc_id, block_index, sha256(block) d, octet_length(block) size from {B256}))"


def _ingested(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return store.ingest_bytes(d, "doc_id", "data", 256)


def _put(spark, sf) -> DataFrame:
    b = _ingested(spark, sf)[0]
    return store.put_blocks(b.select("doc_id", "block_index", "block_key", "size"), ["doc_id", "block_index"])


@query(f"select doc_id, block_index, 'sha-256:' || d || ':' || size as block_key, case when fresh then 'Fresh' else 'Duplicate' end as status from {_PUT}")
def store_put(spark, sf):
    return _put(spark, sf).select("doc_id", "block_index", "block_key", "status")


@query(f"select doc_id, block_index, 'sha-256:' || d || ':' || size as block_key, 'Forwarded' as status from {_PUT} where not fresh")
def store_forward(spark, sf):
    return store.forward_duplicates(_put(spark, sf)).select("doc_id", "block_index", "block_key", "status")


@query(f"select doc_id, sum(size)::bigint as total_bytes, count(*) as block_count, count(*) filter (fresh) as fresh_blocks, count(*) filter (not fresh) as duplicate_blocks, round(count(*) filter (not fresh) / count(*), 9) as dedup_ratio from {_PUT} group by 1")
def store_ingest_stats(spark, sf):
    return store.ingest_stats(_put(spark, sf), ["doc_id"]).withColumn("dedup_ratio", F.round("dedup_ratio", 9))


@query(f"select count(*) as total_blocks, sum(size)::bigint as total_bytes, count(*) filter (fresh) as unique_blocks, sum(size) filter (fresh)::bigint as unique_bytes, round(count(*) filter (not fresh) / count(*), 9) as duplicate_ratio from {_PUT}")
def store_summary(spark, sf):
    """Fixed blocks of all texts, hashed and counted: the flagship."""
    return C.system_stats(_ingested(spark, sf)[0].select("block_key", "size")).withColumn("duplicate_ratio", F.round("duplicate_ratio", 9))


@query(f"select doc_id, block_index as ordinal, 'sha-256:' || sha256(block) || ':' || octet_length(block) as block_key, block_index * 256 as start, block_index * 256 + octet_length(block) - 1 as end from {B256}")
def store_manifest(spark, sf):
    return _ingested(spark, sf)[1]


_ENTRIES = "(select lower(hex(blob_key)) k, block_index ordinal, min(block_offset) st, min(block_offset + size_bytes - 1) en from block_manifest_entry where blob_key is not null group by 1, 2)"


def _stored_manifest(spark, sf) -> DataFrame:
    d = table(spark, sf, "block_manifest_entry").where("blob_key is not null")
    return d.groupBy(I.hex_lower(F.col("blob_key")).alias("k"), F.col("block_index").alias("ordinal")).agg(F.min("block_offset").alias("start"), F.min(F.col("block_offset") + F.col("size_bytes") - 1).alias("end"))


@query(f"with m as (select *, lag(en) over (partition by k order by ordinal) p from {_ENTRIES}) select k, coalesce(string_agg(v, ',' order by v), '') as violations from (select k, case when st < 0 or en < st then 'invalid span at ' || ordinal when p >= st then 'overlap at ' || ordinal end v from m) group by 1")
def store_manifest_validate(spark, sf):
    return store.validate_manifest(_stored_manifest(spark, sf), "k").select("k", F.array_join("violations", ",").alias("violations"))


@query(f"select k, count(*) as entries, sum(en - st + 1)::bigint as covered, (max(en) + 1)::bigint as size from {_ENTRIES} group by 1")
def store_manifest_sizes(spark, sf):
    return store.manifest_sizes(_stored_manifest(spark, sf), "k")


@query(f"select k, ordinal // 16 as page, count(*) as entries, min(st) as start, max(en) as end from {_ENTRIES} group by 1, 2")
def store_pages(spark, sf):
    return store.paginate(_stored_manifest(spark, sf), "k", 16)


@query(f"with p as (select k, ordinal // 16 page, count(*) n, min(st) st, max(en) en from {_ENTRIES} group by 1, 2), q as (select k, n > 0 and page = row_number() over (partition by k order by page) - 1 and coalesce(lag(en) over (partition by k order by page) < st, true) ok from p) select k, count(*) as pages, bool_and(ok) as ok from q group by 1")
def store_root_validate(spark, sf):
    return store.validate_root(store.paginate(_stored_manifest(spark, sf), "k", 16), "k")


@query("select doc_id, octet_length(encode(text))::bigint as size, sha256(text) as digest from documents where text <> ''")
def store_read_back(spark, sf):
    b, m = _ingested(spark, sf)
    r = store.read_back(m, b, "doc_id")
    return r.select("doc_id", "size", F.sha2("data", 256).alias("digest"))


@query("select doc_id, sha256(text) as actual, true as ok from documents where text <> ''")
def store_verify(spark, sf):
    b, m = _ingested(spark, sf)
    want = table(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("expected"))
    return store.verify_stored(m, b, "doc_id", want)


@query(f"select doc_id, block_index, case when doc_id % 5 = 0 and block_index >= 8 then 'Error' when block_index % 5 = 4 then 'Failed' else 'Passed' end as result from {B256}")
def store_verify_blocks(spark, sf):
    """Against key lists that are wrong at every fifth block; those of some documents stop after 8."""
    b = _ingested(spark, sf)[0].select("doc_id", "block_index", "block_key")
    want = b.where("doc_id % 5 <> 0 or block_index < 8").select("doc_id", "block_index", F.when(F.col("block_index") % 5 == 4, "wrong").otherwise(F.col("block_key")).alias("expected"))
    return store.verify_blocks(b, want, ["doc_id"]).select("doc_id", "block_index", "result")


@query("with c as (select doc_id, i as block_index from (select doc_id, unnest(range(0, (octet_length(encode(text)) + 255) // 256)) i from documents where text <> '')) select doc_id, block_index, case when block_index % 5 = 4 then 'Failed' else 'Passed' end as result from c")
def store_blob_verifier(spark, sf):
    """Texts as streams of 100-byte chunks, re-blocked to 256 bytes and checked against key lists that are wrong at every fifth block."""
    d = table(spark, sf, "documents").where("text <> ''").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    chunks = chunking.fixed_blocks(d, ["doc_id"], "data", 100).select("doc_id", F.col("block_index").alias("seq"), F.col("block").alias("chunk"))
    want = _ingested(spark, sf)[0].select("doc_id", "block_index", F.when(F.col("block_index") % 5 == 4, "wrong").otherwise(F.col("block_key")).alias("expected"))
    return store.verify_stream(chunks, ["doc_id"], ["seq"], "chunk", 256, want).select("doc_id", "block_index", "result")


@query(f"select k, sum(en - st + 1)::bigint as size, count(*) as blocks from {_ENTRIES} where k not in (select lower(hex(key)) from blobs where deleted_at is not null and key is not null) group by 1")
def store_delete_stat(spark, sf):
    gone = table(spark, sf, "blobs").where("deleted_at is not null").select(I.hex_lower(F.col("key")).alias("k"))
    return store.stat(store.delete(_stored_manifest(spark, sf), gone, "k"), "k")


_LATEST = "(select algo_id, hash, store_key, status, storage_class, size_bytes from {t} qualify row_number() over (partition by algo_id, hash, store_key order by last_verified_at desc nulls last, size_bytes desc nulls last, status desc nulls last, storage_class desc nulls last) = 1)"


def _latest(spark, sf, name: str) -> DataFrame:
    from blockloom.operators.diff import current_rows

    d = current_rows(table(spark, sf, name), ["algo_id", "hash", "store_key"], {c: F.col(c) for c in ("size_bytes", "status", "storage_class")}, "last_verified_at")
    return d.select(F.concat_ws(":", F.col("algo_id").cast("string"), I.hex_lower(F.col("hash")), I.hex_lower(F.col("store_key"))).alias("k"), "size_bytes", "status", "storage_class")


_KEYED = "(select algo_id || ':' || lower(hex(hash)) || ':' || lower(hex(store_key)) k, size_bytes, status, storage_class from {t})"
_ADV, _CONF = _KEYED.format(t=_LATEST.format(t="replica_mirror")), _KEYED.format(t=_LATEST.format(t="replica"))


@query(f"select k, coalesce(c.size_bytes, a.size_bytes) as size_bytes, coalesce(c.status, a.status) as status, coalesce(c.storage_class, a.storage_class) as storage_class from {_ADV} a full join {_CONF} c using (k)")
def store_attributes(spark, sf):
    return store.resolve_attributes(_latest(spark, sf, "replica_mirror"), _latest(spark, sf, "replica"), "k", ["size_bytes", "status", "storage_class"])


@query(f"with u as (select k, 'size_bytes' field, a.size_bytes::varchar x, c.size_bytes::varchar y from {_ADV} a full join {_CONF} c using (k) union all select k, 'storage_class', a.storage_class, c.storage_class from {_ADV} a full join {_CONF} c using (k)) select field, case when x is null and y is null then 'Missing' when y is null then 'OnlyAdvertised' when x is null then 'OnlyConfirmed' else 'Both' end as state, count(*) as n from u group by 1, 2")
def store_attribute_states(spark, sf):
    d = store.diff_attributes(_latest(spark, sf, "replica_mirror"), _latest(spark, sf, "replica"), "k", ["size_bytes", "storage_class"])
    return d.groupBy("field", "state").agg(F.count(F.lit(1)).alias("n"))


# ---- catalog: lineitem rows as locations of part blocks, suppliers as sectors, nations as stores ----
_LOC = "(select l_partkey block, l_orderkey * 10 + l_linenumber loc, l_suppkey sector_id, case when l_returnflag = 'R' then 'lost' else 'present' end status, case when l_linestatus = 'F' then l_shipdate end verified_at, l_shipdate written_at from lineitem)"
_SEC = "(select s_suppkey sector_id, s_nationkey store_id, s_nationkey % 4 sector_priority from supplier where s_acctbal > 0)"
_STO = "(select n_nationkey store_id, n_name store_type from nation where n_regionkey <> 4)"
_ACTIVE = f"(select * from {_LOC} join {_SEC} using (sector_id) join {_STO} using (store_id) where status = 'present')"
_RANK = "row_number() over (partition by block order by sector_priority, verified_at desc nulls last, written_at desc, loc)"


def _active(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    loc = li.select(
        F.col("l_partkey").alias("block"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("loc"), F.col("l_suppkey").alias("sector_id"),
        F.when(F.col("l_returnflag") == "R", "lost").otherwise("present").alias("status"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("verified_at"), F.col("l_shipdate").alias("written_at"),
    )
    sec = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sector_id"), F.col("s_nationkey").alias("store_id"), (F.col("s_nationkey") % 4).alias("priority"), F.when(F.col("s_acctbal") > 0, "active").otherwise("drained").alias("status"))
    sto = table(spark, sf, "nation").select(F.col("n_nationkey").alias("store_id"), F.col("n_name").alias("store_type"), F.when(F.col("n_regionkey") != 4, "active").otherwise("off").alias("status"))
    return C.active_locations(loc, sec, sto)


@query(f"select block, rank, loc, sector_id, store_type from (select *, {_RANK} as rank from {_ACTIVE}) where rank <= 3")
def catalog_best_locations(spark, sf):
    return C.best_locations(_active(spark, sf), ["block"], ["loc"], 3).select("block", "rank", "loc", "sector_id", "store_type")


@query(f"select block, sector_priority, loc, sector_id from (select *, {_RANK} r from {_ACTIVE}) where r = 1")
def catalog_best_location(spark, sf):
    return C.best_location(_active(spark, sf), ["block"], ["loc", "sector_id"])


@query(f"select p_partkey as block, p_size as ordinal, sector_priority, loc, sector_id from part left join (select *, {_RANK} r from {_ACTIVE}) b on p_partkey = b.block and r = 1")
def catalog_read_plan(spark, sf):
    m = table(spark, sf, "part").select(F.col("p_partkey").alias("block"), F.col("p_size").alias("ordinal"))
    return C.read_plan(m, _active(spark, sf), ["block"], ["loc", "sector_id"])


@query("select lower(hex(key)) as k, block_index, block_offset, size_bytes from (select blob_key as key, block_index, block_offset, size_bytes, row_number() over (partition by blob_key, block_index order by created_at desc nulls last, block_offset, size_bytes) r from block_manifest_entry) where r = 1")
def catalog_top_one(spark, sf):
    d = C.top_one(table(spark, sf, "block_manifest_entry"), ["blob_key", "block_index"], [F.desc_nulls_last("created_at"), F.asc("block_offset"), F.asc("size_bytes")])
    return d.select(I.hex_lower(F.col("blob_key")).alias("k"), "block_index", "block_offset", "size_bytes")


@query("select o_orderkey, o_totalprice, (select count(*) from orders where o_orderstatus = 'F') as total from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 20 offset 40")
def catalog_page(spark, sf):
    d = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return C.page(d, [F.desc("o_orderdate"), F.asc("o_orderkey")], 20, 40).select("o_orderkey", "o_totalprice", "total")


_NEWCUST = "(select c_custkey + 70 c_custkey, upper(c_name) c_name, c_acctbal + 1 c_acctbal from customer)"


@query(f"select coalesce(b.c_custkey, n.c_custkey) as c_custkey, case when n.c_custkey is not null then n.c_name else b.c_name end as c_name, case when n.c_custkey is not null then n.c_acctbal else b.c_acctbal end as c_acctbal, case when b.c_custkey is null then 1 when n.c_custkey is not null then 8 else 7 end as version from customer b full join {_NEWCUST} n on b.c_custkey = n.c_custkey")
def catalog_upsert(spark, sf):
    base, new = _customers(spark, sf)
    return C.upsert(base, new, ["c_custkey"], "version")


def _customers(spark, sf):
    c = table(spark, sf, "customer")
    base = c.select("c_custkey", "c_name", "c_acctbal", F.lit(7).alias("version"))
    new = c.select((F.col("c_custkey") + 70).alias("c_custkey"), F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return base, new


@query(f"select c_custkey, c_name, c_acctbal from customer union all select * from {_NEWCUST} where c_custkey not in (select c_custkey from customer)")
def catalog_insert_new(spark, sf):
    base, new = _customers(spark, sf)
    return C.insert_new(base.drop("version"), new, ["c_custkey"])


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P') union all select o_orderkey, 1, o_totalprice from orders where o_orderstatus = 'P'")
def catalog_replace_group(spark, sf):
    base = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    rows = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("o_totalprice").alias("l_quantity"))
    return C.replace_group(base, rows, ["l_orderkey"])


@query(f"select coalesce(b.c_custkey, n.c_custkey) as c_custkey, case when b.c_custkey is null then 'INSERT' when n.c_custkey is null then 'DELETE' else 'UPDATE' end as op from customer b full join {_NEWCUST} n on b.c_custkey = n.c_custkey where b.c_custkey is null or n.c_custkey is null or b.c_name <> n.c_name or b.c_acctbal <> n.c_acctbal")
def catalog_change_feed(spark, sf):
    base, new = _customers(spark, sf)
    return C.change_feed(base.drop("version"), new, ["c_custkey"]).select("c_custkey", "op")


@query("with k as (select c_custkey, md5('{\"k0\":' || c_custkey || ',\"k1\":\"' || c_mktsegment || '\"}') h from customer) select c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) as id from k")
def catalog_natural_id(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", C.natural_id(F.col("c_custkey"), F.col("c_mktsegment")).alias("id"))


@query("select event_type, count(*) as n, sum(value) as total from events group by 1")
def catalog_partitioned(spark, sf):
    """Written in hash partitions, read back; every key lies in one partition."""
    from blockloom.workspace import fresh_path

    path = fresh_path(spark, "partitioned")
    C.partitioned(table(spark, sf, "events"), "event_type", 8).write.partitionBy("part").parquet(path)
    per = spark.read.parquet(path).groupBy("part", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return per.select("event_type", "n", "total")


@query("select doc_id, title, source, row_number() over (partition by source order by created_at, doc_id) - 1 as ordinal from documents")
def catalog_numbered(spark, sf):
    return C.numbered(table(spark, sf, "documents"), ["source"], ["created_at", "doc_id"]).select("doc_id", "title", "source", "ordinal")


def _catalog(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("document_id"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("blob_hash"), F.col("lang").alias("content_type"), F.col("n_chars").alias("size_bytes"), "created_at", F.col("source").alias("namespace"), "title", F.array("doc_status").alias("tags"),
        F.create_map(F.lit("org"), I.org(F.col("org_id"))).alias("metadata"),
    )


_CAT = f"(select doc_id document_id, sha256(coalesce(text, '')) blob_hash, lang content_type, n_chars size_bytes, created_at, source namespace, title, doc_status, {I.sql_org('org_id')} org from documents)"


@query(f"select document_id, size_bytes from {_CAT} where content_type in ('en', 'de') and size_bytes between 500 and 5000 and (namespace = 'tickets' or contains(lower(title), 'key')) and (contains(lower(title), 's') or contains(lower(namespace), 's')) and doc_status in ('active', 'draft') order by document_id limit 100")
def catalog_search(spark, sf):
    f = [C.Filter("content_type", "=", "en"), C.Filter("content_type", "=", "de"), *C.size_range(500, 5000)]
    either = [[C.Filter("namespace", "=", "tickets"), C.Filter("title", "contains", "key")]]
    return C.search(_catalog(spark, sf), f, either, "s", ["active", "draft"], size=100).select("document_id", "size_bytes")


@query(f"select document_id, org from {_CAT} where org = (select min(org) from {_CAT})")
def catalog_own_rows(spark, sf):
    d = _catalog(spark, sf).select("document_id", F.col("metadata")["org"].alias("org"))
    least = d.agg(F.min("org")).first()[0]
    return C.own_rows(d, least, "org")


@query(f"select document_id, blob_hash from {_CAT} where document_id > 100 order by document_id limit 50")
def catalog_list(spark, sf):
    return C.keyset_page(_catalog(spark, sf), "document_id", 100, 50).select("document_id", "blob_hash")


@query(f"select blob_hash, size_bytes, count(*) as copies, min(document_id) as first_document, max(document_id) as last_document from {_CAT} group by 1, 2 having count(*) > 1")
def catalog_duplicates(spark, sf):
    return C.find_duplicates(_catalog(spark, sf))


@query(f"select document_id, created_at from {_CAT} order by created_at desc nulls last, document_id desc limit 20")
def catalog_newest(spark, sf):
    return C.newest(_catalog(spark, sf), "created_at", "document_id").select("document_id", "created_at")


@query("with e as (select distinct lower(hex(blob_key)) k, block_index o, block_offset st, block_offset + size_bytes en from block_manifest_entry where size_bytes > 0) select x.k, x.o as a, y.o as b from e x join e y on x.k = y.k and x.o < y.o and x.st <= y.en and y.st <= x.en")
def catalog_overlaps(spark, sf):
    """Of spans that end a byte late, so that each meets the block after it."""
    e = table(spark, sf, "block_manifest_entry").where("size_bytes > 0").select(I.hex_lower(F.col("blob_key")).alias("k"), F.col("block_index").alias("ordinal"), F.col("block_offset").alias("start"), (F.col("block_offset") + F.col("size_bytes")).alias("end")).distinct()
    return C.overlapping_spans(e, ["k"]).select("k", "a", "b")


@query("with recursive e as (select n_nationkey c, n_nationkey // 3 p from nation where n_nationkey > 0), up(c, p, depth) as (select c, p, 1 from e union all select up.c, e.p, up.depth + 1 from up join e on up.p = e.c) select c as child, arg_max(p, depth) as root, max(depth) as depth from up group by 1")
def catalog_ancestors(spark, sf):
    e = table(spark, sf, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").alias("child"), F.expr("n_nationkey div 3").cast("int").alias("parent"))
    return C.ancestors(e)


@query("select l_orderkey, l_linenumber from lineitem where not (l_quantity > 5 and l_quantity <= 40) or not (l_discount between 0 and 0.07) or not (l_returnflag in ('A', 'N')) or length(l_linestatus) <> 1 or l_tax is null")
def catalog_checks(spark, sf):
    checks = ("CHECK ((l_quantity > 5) AND (l_quantity <= 40))", "l_discount BETWEEN 0 AND 0.07", "CHECK (l_returnflag IN ('A', 'N'))", "length(l_linestatus) = 1", "l_tax IS NOT NULL")
    rules = {c: C.parse_check(c, n) for c, n in zip(checks, ("l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_tax"))}
    return D.refined(table(spark, sf, "lineitem"), rules)[1].select("l_orderkey", "l_linenumber")


@query("select distinct lower(hex(key)) as key_hex, octet_length(checksum) as digest_bytes, base64(checksum) as digest, row_version from blobs where checksum is not null")
def catalog_cas_ref(spark, sf):
    d = table(spark, sf, "blobs").where("checksum is not null")
    return d.select(I.hex_lower(F.col("key")).alias("key_hex"), F.octet_length("checksum").cast("bigint").alias("digest_bytes"), F.base64("checksum").alias("digest"), "row_version").distinct()


@query("select o_orderkey as job_id, o_orderdate as run_at from orders where o_orderstatus = 'O' and o_orderdate <= timestamp '1998-01-01' and (o_totalprice < 1000 or o_orderdate < timestamp '1997-01-01') order by o_orderdate, o_orderkey limit 50")
def catalog_runnable(spark, sf):
    return C.runnable_jobs(_jobs(spark, sf), F.lit("1998-01-01").cast("timestamp_ntz"), 50).select("job_id", "run_at")


def _jobs(spark, sf):
    """Orders as jobs; cheap ones carry no lease, others one of a year."""
    lease = F.when(F.col("o_totalprice") >= 1000, F.col("o_orderdate") + F.expr("interval 365 days"))
    late = F.when(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"), F.lit(None)).otherwise(lease)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"), F.col("o_orderdate").alias("run_at"), late.alias("lease_until"))


@query("select count(*) as queued from orders where o_orderstatus = 'O'")
def catalog_queued(spark, sf):
    return C.queued_count(_jobs(spark, sf))


@query(f"select o as org_id, max(seq) + 1 as next_seq, arg_max(lower(hex(r.h)), seq) as prev_hash from (select {I.sql_org('org_id')} o, seq, max(struct_pack(h := row_hash)) r from audit_record where org_id is not null and seq is not null group by 1, 2) group by 1")
def catalog_next_audit(spark, sf):
    a = table(spark, sf, "audit_record").select(I.org(F.col("org_id")).alias("org_id"), "seq", "row_hash").where("org_id is not null")
    a = a.groupBy("org_id", "seq").agg(F.max("row_hash").alias("row_hash"))
    return C.next_audit(a, ["org_id"], "seq", "row_hash").select("org_id", "next_seq", F.lower(F.hex("prev_hash")).alias("prev_hash"))


@query("select distinct lower(hex(hash)) as hash_hex, coalesce(lower(storage_class), '') || '://' || coalesce(sector, '') || '/' || lower(hex(store_key)) as locator, sector is not null as ok from replica")
def catalog_locators(spark, sf):
    loc = F.to_json(F.struct(F.col("sector").alias("bucket"), I.hex_lower(F.col("store_key")).alias("key")))
    d = table(spark, sf, "replica")
    return d.select(I.hex_lower(F.col("hash")).alias("hash_hex"), C.locator_canonical(F.lower("storage_class"), F.col("sector"), I.hex_lower(F.col("store_key"))).alias("locator"), C.locator_ok(F.lit("s3"), loc).alias("ok")).distinct()


@query("select lower(hex(key)) as key_hex, size_bytes, checksum is not null as inline, row_version from blobs")
def catalog_head(spark, sf):
    b = table(spark, sf, "blobs")
    return C.head(b.withColumn("k", F.struct(I.hex_lower(F.col("key")).alias("key_hex"), "row_version")), "k", "checksum", "size_bytes").select("k.key_hex", "size_bytes", "inline", "k.row_version")


@query("select action_name, count(*) as n from audit_record where action_name in ('blob.read', 'blob.write') group by 1")
def catalog_subscribe(spark, sf):
    return C.subscribe(table(spark, sf, "audit_record"), ["blob.read", "blob.write"], "action_name").groupBy("action_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"select doc_id, block_index as ordinal, sha256(block) as digest from {B256} b where doc_id in (select doc_id from documents where doc_status = 'draft')")
def catalog_export(spark, sf):
    b, m = _ingested(spark, sf)
    chosen = table(spark, sf, "documents").where("doc_status = 'draft'").select("doc_id")
    return C.export(m, b, chosen, "doc_id").select("doc_id", "ordinal", F.sha2("block", 256).alias("digest"))


_TYPES = "case column_type when 'VARCHAR' then 'string' when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'BLOB' then 'binary' when 'BOOLEAN' then 'boolean' when 'DOUBLE' then 'double' when 'TIMESTAMP' then 'timestamp_ntz' else column_type end"


@query(" union all ".join(f"select '{t}' as table_name, (row_number() over () - 1)::int as ordinal, column_name, {_TYPES} as type, true as nullable from (describe {t})" for t in ("documents", "blobs", "audit_record")))
def catalog_schema(spark, sf):
    parts = [C.describe(table(spark, sf, t), t) for t in ("documents", "blobs", "audit_record")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- governance ----
_MASK = "(case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 8 else 16 end)::bigint"


@query(f"with a as (select user_id, coalesce(bit_or({_MASK}) filter (event_id % 3 <> 0), 0) allow, coalesce(bit_or({_MASK}) filter (event_id % 3 = 0), 0) deny from events group by 1) select user_id, allow, deny, (64 | allow) & ~deny as effective, ((64 | allow) & ~deny) & 2 <> 0 as can_write from a")
def govern_acl(spark, sf):
    bit = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 8).otherwise(16).cast("bigint")
    e = table(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 3 == 0, "deny").otherwise("allow").alias("effect"), bit.alias("capabilities"))
    m = govern.acl_masks(e, ["user_id"])
    eff = govern.effective_mask(F.lit(64).cast("bigint"), F.col("allow"), F.col("deny"))
    return m.select("user_id", "allow", "deny", eff.alias("effective"), govern.has_capability(eff, "blob.write").alias("can_write"))


@query("select action_name, bit_or(case action_name when 'blob.read' then 1 when 'blob.write' then 2 when 'blob.delete' then 4 when 'doc.read' then 8 when 'doc.write' then 16 when 'doc.delete' then 32 when 'ns.admin' then 64 when 'acl.admin' then 128 when 'audit.read' then 512 else 0 end)::bigint | 1024 as mask from audit_record where action_name is not null group by 1")
def govern_scopes(spark, sf):
    a = table(spark, sf, "audit_record").where("action_name is not null").select("action_name").distinct()
    return a.select("action_name", govern.scope_mask(F.concat(F.col("action_name"), F.lit("  legal_hold.write unknown"))).alias("mask"))


_AUDIT = f"(select {I.sql_org('org_id')} o, seq, min(struct_pack(p := prev_hash, h := row_hash)) r from audit_record where org_id is not null and seq is not null group by 1, 2)"


@query(f"with w as (select o, seq, r.p p, coalesce(lag(r.h) over (partition by o order by seq), unhex('{'00' * 32}')) want, row_number() over (partition by o order by seq) i from {_AUDIT}), b as (select o, min(seq) filter (p is distinct from want) pos, min(i) filter (p is distinct from want) n, count(*) c from w group by 1) select o as org_id, pos is null as ok, pos as broken_at, coalesce(n, c) as total from b")
def govern_chain(spark, sf):
    a = table(spark, sf, "audit_record").select(I.org(F.col("org_id")).alias("org_id"), "seq", "prev_hash", "row_hash").where("org_id is not null")
    return govern.chain_breaks(a, ["org_id"], "seq", "prev_hash", "row_hash", segment=1000)


@query(f"select user_id, list_reduce(list_prepend('{'00' * 32}', list(event_type || '|' || event_id order by ts, event_id)), lambda a, x: sha256(unhex(a) || encode(x))) as head, count(*) as rows from events group by 1")
def govern_hash_chain(spark, sf):
    return govern.hash_chain(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.concat_ws("|", "event_type", F.col("event_id").cast("string")))


@query("select user_id, list_reduce(list_prepend(0::bigint, list(cast(floor(value) as bigint) order by ts, event_id)), lambda a, x: case when a + x <= 700 then a + x else a end) as used from events where value is not null group by 1")
def govern_quota(spark, sf):
    e = table(spark, sf, "events").withColumn("n", F.floor("value"))
    return govern.quota(e, ["user_id"], ["ts", "event_id"], "n", 700).select("user_id", "used")


def _timed(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", F.expr("unix_millis(cast(ts as timestamp))").alias("ms"), F.floor("value").cast("bigint").alias("n"), "value")


@query()
def govern_rate_limit(spark, sf):
    return govern.rate_limit(_timed(spark, sf), ["user_id"], ["ms", "event_id"], "ms", "n", 100)


@query()
def govern_breaker(spark, sf):
    e = _timed(spark, sf).withColumn("ok", F.col("value") < 60)
    return govern.circuit_breaker(e, ["user_id"], ["ms", "event_id"], "ms", "ok", 3, 3_600_000)


@query("select o_orderkey, (o_totalprice < 20000 or o_totalprice / 500000 < 0.1) as low from orders")
def govern_disk_low(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", govern.disk_low(F.col("o_totalprice"), F.lit(500000.0), 20000, 0.1).alias("low"))


@query("select event_type as name, user_id as tags, count(*) as count, arg_max(value, struct_pack(ts := ts, e := event_id)) as last from events group by 1, 2")
def govern_metrics(spark, sf):
    return govern.metric_values(table(spark, sf, "events"), "event_type", "user_id", "value", ["ts", "event_id"]).withColumnsRenamed({"event_type": "name", "user_id": "tags"})


@query("""select 'events_total{kind="' || event_type || '",user="' || user_id || '"} ' || count(*) as line from events group by event_type, user_id""")
def govern_prometheus(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("value"))
    tags = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"))
    return govern.prometheus_lines(e.select(F.lit("events_total").alias("name"), tags.alias("tags"), "value"))


@query("with recursive t as (select sha256(coalesce(text, '')) h, doc_id from documents), e as (select min(doc_id) over (partition by h) u, doc_id v from t) select v as node, u as root from e")
def govern_components(spark, sf):
    """Documents of equal text as one component: edges from each document to the next of its text."""
    from pyspark.sql import Window

    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("h"))
    e = d.select("doc_id", F.coalesce(F.lag("doc_id").over(Window.partitionBy("h").orderBy("doc_id")), F.col("doc_id")).alias("prev"))
    return govern.connected_components(e, "doc_id", "prev")


@query("select lower(hex(key)) as key_hex, status, case when status = 'valid' and attributes is null then 'data isn''t JSON' when status <> 'valid' then 'status is ' || status end as error, case when status = 'valid' then json_extract_string(attributes, '$.origin') end as origin from (select key, attributes, case row_version % 3 when 1 then 'valid' when 2 then 'quarantined' else 'unverified' end status from blobs)")
def govern_envelope(spark, sf):
    s = F.when(F.col("row_version") % 3 == 1, "valid").when(F.col("row_version") % 3 == 2, "quarantined").otherwise("unverified")
    d = govern.envelope(table(spark, sf, "blobs").withColumn("status", s), "status", "attributes", "origin string")
    return d.select(I.hex_lower(F.col("key")).alias("key_hex"), "status", "error", F.col("decoded.origin").alias("origin"))


@query("with r as (select 'r' || o_custkey % 7 repo, o_orderkey doc, o_custkey % 50 h from orders), d as (select 'r' || o_custkey % 7 repo, o_orderkey doc from orders where o_orderstatus = 'F'), b as (select 'r' || n_nationkey % 7 repo, n_nationkey h, 'blob-' || n_nationkey k from nation) select r.repo, r.doc, r.h as binary_hash, case when d.doc is not null then 'skip' when b.k is not null then 'reuse' else 'ingest' end as action, case when d.doc is null then b.k end as blob_key from r left join d on r.repo = d.repo and r.doc = d.doc left join b on r.repo = b.repo and r.h = b.h")
def govern_import(spark, sf):
    o = table(spark, sf, "orders")
    repo = F.concat(F.lit("r"), (F.col("o_custkey") % 7).cast("string"))
    req = o.select(repo.alias("repo"), F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 50).alias("binary_hash"))
    docs = o.where("o_orderstatus = 'F'").select(repo.alias("repo"), F.col("o_orderkey").alias("doc"), F.lit("imported").alias("status"))
    h = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))
    bins = h.select(F.concat(F.lit("r"), (F.col("id") % 7).cast("string")).alias("repo"), F.col("id").alias("binary_hash"), F.concat(F.lit("blob-"), F.col("id").cast("string")).alias("blob_key"))
    return govern.import_plan(req, docs, bins)


@query("select source, count(*) as n, sha256('[' || string_agg(doc_id::varchar, ',' order by created_at, doc_id) || ']') as snapshot from documents group by 1")
def govern_selection(spark, sf):
    return govern.selection_snapshot(table(spark, sf, "documents"), ["source"], ["created_at", "doc_id"], "doc_id")


@query("with e as (select user_id, ts, event_id, cast(floor(value) as bigint) ack, row_number() over (partition by user_id order by ts, event_id) i, count(*) over (partition by user_id) n from events), f as (select *, lag(ack) over (partition by user_id order by i) p from e) select user_id, count(*) filter (ack <= p) = 0 as ok, case when count(*) filter (ack <= p) > 0 then 'offset doesn''t rise' else '' end as problems from f group by 1")
def govern_upload_acks(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("ack", F.floor("value")).withColumn("kind", F.when(F.row_number().over(w) == 1, "start").when(F.lead("event_id").over(w).isNull(), "complete").otherwise("chunk"))
    return govern.frame_acks(e, "user_id", ["ts", "event_id"], "kind", "ack").select("user_id", "ok", F.array_join("problems", ",").alias("problems"))
