"""Stream operators and programs over ``events`` (a stream per user) and ``documents``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import digests as D
from blockloom.operators import chunking, govern
from blockloom.operators import transduce as X
from blockloom.plans import algebra as A
from blockloom.workspace import table

PART, ORDER = ["user_id"], ["ts", "event_id"]
OVER = "over (partition by user_id order by ts, event_id rows between unbounded preceding and current row)"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def _day(c: str = "ts"):
    return F.date_trunc("day", F.col(c))


@query("select event_id, user_id, ts, value * 2 as doubled from events where event_type <> 'view' and value * 2 > 1")
def stream_map_filter(spark, sf):
    p = A.Map({"doubled": F.col("value") * 2}) >> A.where(F.col("event_type") != "view") >> A.where(F.col("doubled") > 1)
    return p.run(_events(spark, sf), PART, ORDER).select("event_id", "user_id", "ts", "doubled")


@query("select doc_id, cast(generate_subscripts(w, 1) - 1 as bigint) as idx, unnest(w) as word from (select doc_id, string_split(title, ' ') w from documents where title is not null)")
def stream_flat_map(spark, sf):
    d = table(spark, sf, "documents").where("title is not null").select("doc_id", "title")
    return A.FlatMap("word", F.split("title", " ")).run(d, ["doc_id"], ["doc_id"]).select("doc_id", "idx", "word")


@query(f"select event_id, user_id, count(*) {OVER} as count, sum(octet_length(encode(coalesce(props, '')))) {OVER} as bytes, sum(cast(floor(value) as bigint)) {OVER} as total from events")
def stream_running(spark, sf):
    sums = {"count": F.lit(1).cast("bigint"), "bytes": F.octet_length(F.coalesce("props", F.lit(""))).cast("bigint"), "total": F.floor("value").cast("bigint")}
    return X.running_sum(_events(spark, sf), PART, ORDER, sums, segment=_day()).select("event_id", "user_id", *sums)


@query("select event_id, user_id, array_to_string(list(event_type) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), ',') as recent from events")
def stream_window3(spark, sf):
    return X.sliding(_events(spark, sf), PART, ORDER, "event_type", 3).select("event_id", "user_id", F.array_join("window", ",").alias("recent"))


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) r from events) where r = 1")
def stream_dedup(spark, sf):
    return X.dedup(_events(spark, sf), PART, ORDER, ["event_type"]).select("user_id", "event_type", "event_id")


@query("select user_id, count(distinct event_type) as unique_count, count(*) - count(distinct event_type) as duplicate_count from events group by 1")
def stream_dedup_summary(spark, sf):
    return X.dedup_summary(_events(spark, sf), PART, ["event_type"])


@query("select user_id, batch, string_agg(event_id::varchar, ',' order by i) as items from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 i, (row_number() over (partition by user_id order by ts, event_id) - 1) // 7 as batch from events) group by 1, 2")
def stream_batch(spark, sf):
    return X.batches(_events(spark, sf), PART, ORDER, "event_id", 7).select("user_id", "batch", F.array_join("items", ",").alias("items"))


@query("select user_id, run, event_type, count(*) as n from (select *, sum(c) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from (select *, case when lag(event_type) over (partition by user_id order by ts, event_id) is distinct from event_type or row_number() over (partition by user_id order by ts, event_id) = 1 then 1 else 0 end c from events)) group by 1, 2, 3")
def stream_run_groups(spark, sf):
    return X.run_groups(_events(spark, sf), PART, ORDER, "event_type")


@query("select user_id, round(list_reduce(list(value order by ts, event_id), lambda a, x: a * (1 - 0.25::double) + x * 0.25::double), 6) as ema, count(*)::int as samples from events where value is not null group by 1")
def stream_ema(spark, sf):
    return X.ema(_events(spark, sf), PART, ORDER, "value", 0.25).select("user_id", F.round("ema", 6).alias("ema"), "samples")


@query("select user_id, round(list_reduce(list_prepend(100::double, list(value order by ts, event_id)), lambda a, x: a * (1 - 0.1::double) + x * 0.1::double), 6) as rate, count(*)::int as samples from events where value is not null group by 1")
def stream_rate(spark, sf):
    return X.ema(_events(spark, sf), PART, ORDER, "value", 0.1, start=100.0, name="rate").select("user_id", F.round("rate", 6).alias("rate"), "samples")


@query("select user_id, min(value) as min, max(value) as max from events group by 1")
def stream_min_max(spark, sf):
    return X.min_max(_events(spark, sf), PART, "value")


@query("select cast(trunc(value) as bigint) // 10 as bucket, count(*) as n from events where value is not null group by 1")
def stream_histogram(spark, sf):
    return govern.histogram(_events(spark, sf), "value", 10)


@query("select event_id, user_id, total_seen from (select *, sum(octet_length(encode(props))) over (partition by user_id order by ts, event_id rows unbounded preceding) as total_seen from events) where total_seen <= 600")
def stream_bomb_guard(spark, sf):
    return X.bomb_guard(_events(spark, sf), PART, ORDER, F.octet_length("props"), 600, segment=_day()).select("event_id", "user_id", "total_seen")


@query("select user_id, sum(octet_length(encode(props)))::bigint as total_seen, sum(octet_length(encode(props))) > 600 as rejected, 600::bigint as max_bytes from events group by 1")
def stream_bomb_summary(spark, sf):
    return X.bomb_summary(_events(spark, sf), PART, F.octet_length("props"), 600)


@query()
def stream_reservoir(spark, sf):
    return X.reservoir(_events(spark, sf), PART, ["event_id"], 5).select("user_id", "event_id")


@query("select user_id, ts, event_id, count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) as n, value as v from events")
def stream_fanout_one(spark, sf):
    p = A.par(A.counter("n"), A.Map({"v": F.col("value")}), ["n"], ["v"], "one")
    return p.run(_events(spark, sf), PART, ORDER).select("user_id", "ts", "event_id", "n", "v")


@query("with e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) k from events), a as (select user_id, event_id a_id, row_number() over (partition by user_id order by k) n from e where event_type = 'purchase'), b as (select user_id, event_id b_id, row_number() over (partition by user_id order by k) n from e where event_type <> 'purchase') select user_id, a_id, b_id from a join b using (user_id, n)")
def stream_fanout_buffered(spark, sf):
    p = A.par(
        A.where(F.col("event_type") == "purchase") >> A.Map({"a_id": F.col("event_id")}), A.where(F.col("event_type") != "purchase") >> A.Map({"b_id": F.col("event_id")}), ["a_id"], ["b_id"], "buffered"
    )
    return p.run(_events(spark, sf), PART, ORDER).select("user_id", "a_id", "b_id")


@query("with t as (select doc_id, string_split(title, ' ') w from documents where title is not null), x as (select doc_id, unnest(w) a, generate_subscripts(w, 1) i from t), y as (select doc_id, unnest(list_filter(w, lambda s: length(s) > 4)) b, generate_subscripts(list_filter(w, lambda s: length(s) > 4), 1) i from t) select doc_id, a, b from x join y using (doc_id, i)")
def stream_fanout_step(spark, sf):
    d = table(spark, sf, "documents").where("title is not null").select("doc_id", "title")
    p = A.par(A.FlatMap("a", F.split("title", " ")), A.FlatMap("b", F.filter(F.split("title", " "), lambda s: F.length(s) > 4)), ["a"], ["b"], "step")
    return p.run(d, ["doc_id"], ["doc_id"]).select("doc_id", "a", "b")


@query("select event_id, user_id, case when value >= 50 then 'right' else 'left' end as branch, count(*) over (partition by user_id, value >= 50 order by ts, event_id rows unbounded preceding) as n from events where value is not null")
def stream_choice(spark, sf):
    p = A.choice(F.col("value") >= 50, A.counter("n"), A.counter("n"))
    return p.run(_events(spark, sf).where("value is not null"), PART, ORDER).select("event_id", "user_id", "branch", "n")


@query("select event_id, user_id, upper(event_type) as first, value + 1 as second from events")
def stream_product(spark, sf):
    p = A.product(A.Map({"first": F.upper("event_type")}), A.Map({"second": F.col("value") + 1}))
    return p.run(_events(spark, sf), PART, ORDER).select("event_id", "user_id", "first", "second")


@query(f"select user_id, event_id, count(*) {OVER} as n, false as is_tail from events union all select user_id, null, count(*), true from events group by 1")
def stream_scan_tail(spark, sf):
    return X.scan_with_tail(_events(spark, sf), PART, ORDER, {"n": F.lit(1).cast("bigint")}).select("user_id", "event_id", "n", "is_tail")


@query("select user_id, count(*) as outputs, sum(value) as total from events where value > 10 group by 1")
def stream_summarize(spark, sf):
    return A.where(F.col("value") > 10).summarize(_events(spark, sf), PART, ORDER, {"outputs": F.count(F.lit(1)), "total": F.sum("value")})


_BYTES = "list_transform(generate_series(1, octet_length(encode(event_type))), lambda i: ('0x' || substr(hex(encode(event_type)), i * 2 - 1, 2))::bigint)"


@query(f"with e as (select user_id, event_id, ts, list_sum({_BYTES})::bigint byte_sum, list_max({_BYTES}) >= 128 hi from events) select user_id, event_id, byte_sum, (sum(byte_sum) over (partition by user_id order by ts, event_id rows between 3 preceding and current row))::bigint window_total, byte_sum % 2 = 0 or hi as flagged from e")
def stream_window_annotate(spark, sf):
    d = _events(spark, sf).withColumn("frame", F.encode("event_type", "UTF-8"))
    return X.window_annotate(d, PART, ORDER, "frame", 4).select("user_id", "event_id", "byte_sum", "window_total", "flagged")


@query("select user_id, string_agg(event_type, '' order by ts, event_id) like '%viewclick%' as stopped, case when string_agg(event_type, '' order by ts, event_id) like '%viewclick%' then 'marker' end as reason, count(*)::int as frames from events group by 1")
def stream_short_circuit(spark, sf):
    d = _events(spark, sf).withColumn("frame", F.encode("event_type", "UTF-8"))
    return X.short_circuit(d, PART, ORDER, "frame", b"viewclick", "marker").select("user_id", "stopped", "reason", "frames")


@query(f"with e as (select *, octet_length(encode(props)) n from events) select user_id, event_id, case when n >= 40 then 'large' else 'small' end as route, row_number() over (partition by user_id order by ts, event_id) as ordinal, (sum(n) {OVER})::bigint as bytes, null::varchar as mime_hint, sum(n) {OVER} > 2000 as halted from e")
def stream_telemetry(spark, sf):
    d = _events(spark, sf).withColumn("chunk", F.encode("props", "UTF-8"))
    return X.telemetry_steps(d, PART, ORDER, "chunk", 2000, 40).select("user_id", "event_id", "route", "ordinal", "bytes", "mime_hint", "halted")


@query("select user_id, sum(octet_length(encode(props)))::bigint as bytes, count(*) as chunks, null::varchar as mime_hint, sha256(string_agg(props, '' order by ts, event_id)) as sha256 from events group by 1")
def stream_telemetry_final(spark, sf):
    d = _events(spark, sf).withColumn("chunk", F.encode("props", "UTF-8"))
    return X.telemetry_final(d, PART, ORDER, "chunk")


@query("select user_id, sum(octet_length(encode(props)))::bigint as bytes, count(*) as chunks, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as elapsed_seconds, case when max(ts) > min(ts) then round(sum(octet_length(encode(props))) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) end as bytes_per_second from events group by 1")
def stream_throughput(spark, sf):
    t = X.throughput(_events(spark, sf), PART, F.octet_length("props"), "ts")
    return t.withColumn("bytes_per_second", F.round("bytes_per_second", 9))


@query("select user_id, list_reduce(list_prepend(0::bigint, list(cast(floor(value) as bigint) order by ts, event_id)), lambda a, x: (a * 31 + x) % 1000003) as state from events where value is not null group by 1")
def stream_fold(spark, sf):
    e = _events(spark, sf).where("value is not null")
    return X.fold(e, PART, ORDER, F.floor("value").cast("bigint"), F.lit(0).cast("bigint"), lambda a, x: (a * 31 + x) % 1000003)


@query("select user_id, event_id as ended_by, n from (select *, row_number() over (partition by user_id order by ts, event_id) i, count(*) over (partition by user_id) c from events) join (select user_id u, count(*) n from events group by 1) on u = user_id where i = c")
def stream_fold_emit(spark, sf):
    """A machine that gives one row at the end of each stream."""

    def machine(rows):
        last, n = None, 0
        for (last,) in rows:
            n += 1
        yield last, n

    return X.fold_emit(_events(spark, sf), PART, ORDER, ["event_id"], "ended_by bigint, n bigint", machine)


@query("select user_id, sha256(string_agg(props, '' order by ts, event_id)) as digest, sum(octet_length(encode(props)))::bigint as hashed_bytes from events group by 1")
def stream_hash(spark, sf):
    d = _events(spark, sf).withColumn("chunk", F.encode("props", "UTF-8"))
    return X.hash_stream(d, PART, ORDER, "chunk")


@query("with h as (select user_id, string_agg(hex(encode(props)), '' order by ts, event_id) h from events group by 1), k as (select user_id, unnest(range(0, (length(h) // 2 + 99) // 100)) i, h from h), b as (select user_id, i, substr(h, i * 200 + 1, 200) x from k) select user_id, i as block_index, 'sha-256:' || sha256(unhex(x)) || ':' || length(x) // 2 as block_key from b")
def stream_ingest_keys(spark, sf):
    d = _events(spark, sf).withColumn("chunk", F.encode("props", "UTF-8"))
    return X.ingest_keys(d, PART, ORDER, "chunk", 100).select("user_id", "block_index", "block_key")


@query("with h as (select user_id, string_agg(hex(encode(props)), '' order by ts, event_id) h from events group by 1) select user_id, length(h) // 200 as frames, (length(h) // 2) % 100 as left_over from h")
def stream_whole_frames(spark, sf):
    d = _events(spark, sf).withColumn("chunk", F.encode("props", "UTF-8"))
    frames, rest = chunking.whole_frames(d, PART, ORDER, "chunk", 100)
    g = frames.groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"))
    j = g.join(rest, "user_id", "full")
    return j.select("user_id", F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce(F.octet_length("left_over"), F.lit(0)).cast("bigint").alias("left_over"))


@query("select request_id, seq, case when regexp_full_match(request_id, '[0-9]+') then request_id::bigint end as as_int, seq as as_hex from audit_record where request_id is not null and seq >= 0")
def stream_parse(spark, sf):
    d = table(spark, sf, "audit_record").where("request_id is not null and seq >= 0")
    return d.select("request_id", "seq", D.parse_int(F.col("request_id")).alias("as_int"), D.parse_hex_size(F.hex("seq")).alias("as_hex"))


@query(f"with l as (select user_id, event_id, value, list(value) {OVER} l from events where value is not null) select user_id, event_id, value, list_reduce(l, lambda a, x: a * 0.75 + x * 0.25) as ema from l")
def stream_ema_running(spark, sf):
    return X.ema_running(_events(spark, sf), PART, ORDER, "value", 0.25).select("user_id", "event_id", "value", "ema")


@query("select user_id, sum(octet_length(encode(props)))::bigint as bytes, count(*) as chunks, sha256(string_agg(props, '' order by ts, event_id)) as sha256, ((sum(octet_length(encode(props))) + 99) // 100)::bigint as blocks from events group by 1")
def stream_count_hash_rechunk(spark, sf):
    d = _events(spark, sf).withColumn("chunk", F.encode("props", "UTF-8"))
    blocks, summary = X.count_hash_rechunk(d, PART, ORDER, "chunk", 100)
    return summary.join(blocks.groupBy("user_id").agg(F.count(F.lit(1)).alias("blocks")), "user_id", "left").select("user_id", "bytes", "chunks", "sha256", F.coalesce("blocks", F.lit(0)).alias("blocks"))


@query("select count(*) as rows, sum(octet_length(encode(props)))::bigint as bytes from events")
def stream_observed(spark, sf):
    """What passes a running query, counted beside it: block and byte totals."""
    d, seen = X.observed(_events(spark, sf), "passed", F.octet_length("props"))
    d.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], seen.get["bytes"])], "rows bigint, bytes bigint")


@query("select user_id, count(*) as n, sum(floor(value))::bigint as total, min(value) as low, max(value) as high from events group by 1")
def stream_state_merge(spark, sf):
    """The states of two summaries merged into one record with the fields of both."""
    e = _events(spark, sf)
    left = e.groupBy("user_id").agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value")).cast("bigint").alias("total")).alias("a"))
    right = e.groupBy("user_id").agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high")).alias("b"))
    m = X.merge_structs(F.col("a"), F.col("b"), ["n", "total"], ["low", "high"])
    return left.join(right, "user_id").select("user_id", m.alias("s")).select("user_id", "s.*")


# ---- blocks of documents ----
_BLOCKS = "(select doc_id, i as block_index, b[i * {n} + 1 : least(i * {n} + {n}, octet_length(b))] as block from (select doc_id, encode(text) b, unnest(range(0, (octet_length(encode(text)) + {n} - 1) // {n})) i from documents where text <> ''))"
B256 = _BLOCKS.format(n=256)


def _objects(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", F.encode("text", "UTF-8").alias("data"))


@query(f"select doc_id, block_index, octet_length(block)::bigint as size, sha256(block) as digest from {B256}")
def chunk_fixed(spark, sf):
    b = chunking.fixed_blocks(_objects(spark, sf), ["doc_id"], "data", 256)
    return b.select("doc_id", "block_index", F.octet_length("block").cast("bigint").alias("size"), F.sha2("block", 256).alias("digest"))


@query("with s as (select doc_id, string_split(text, chr(10)) l from documents where text is not null), f as (select doc_id, list_filter(l, lambda x: x <> '') l from s) select doc_id, (generate_subscripts(l, 1) - 1)::int as block_index, sha256(unnest(l)) as digest from f")
def chunk_lines(spark, sf):
    b = chunking.split_lines(table(spark, sf, "documents"), ["doc_id"], "text")
    return b.select("doc_id", "block_index", F.sha2(F.encode("block", "UTF-8"), 256).alias("digest"))


@query("with s as (select doc_id, string_split(text, chr(10)) l from documents where text is not null), f as (select doc_id, list_filter(l, lambda x: x <> '') l from s) select doc_id, (generate_subscripts(l, 1) - 1)::bigint as block_index, sha256(unnest(l)) as digest from f")
def chunk_delimiter(spark, sf):
    b = chunking.delimiter_blocks(_objects(spark, sf), "doc_id", "data", b"\n", include=False)
    return b.select("doc_id", "block_index", F.sha2("block", 256).alias("digest"))


@query()
def chunk_cdc(spark, sf):
    b = chunking.cdc_blocks(_objects(spark, sf), "doc_id", "data", 64, 256, 1024)
    return b.select("doc_id", "block_index", "block_start", F.sha2("block", 256).alias("digest"))


@query()
def chunk_anchored(spark, sf):
    b = chunking.anchored_blocks(_objects(spark, sf), "doc_id", "data", 64, 256, 1024, anchor=b"endstream")
    return chunking.ingest_events(b, "doc_id")


@query(f"with s as (select source, string_agg(hex(encode(text)), '' order by doc_id) h from documents where text <> '' and source is not null group by 1), k as (select source, unnest(range(0, (length(h) // 2 + 999) // 1000)) i, h from s) select source, i as block_index, sha256(unhex(substr(h, i * 2000 + 1, 2000))) as digest from k")
def chunk_rechunk(spark, sf):
    d = _objects(spark, sf).where("source is not null")
    b = chunking.rechunk(d, ["source"], ["doc_id"], "data", 1000)
    return b.select("source", "block_index", F.sha2("block", 256).alias("digest"))


@query("select source, sum(octet_length(encode(text)))::bigint as total_bytes, (sum(octet_length(encode(text))) // 4096)::bigint as block_count, 0 as fill from documents group by 1")
def chunk_rechunk_summary(spark, sf):
    return chunking.rechunk_summary(_objects(spark, sf), ["source"], "data", 4096).withColumn("total_bytes", F.col("total_bytes"))


@query(f"with b as (select doc_id, sha256(block) d, octet_length(block) s from {B256}), p as (select d, doc_id, count(*) n, max(s) s from b group by 1, 2), f as (select d, count(*) files from p group by 1) select doc_id, sum(n)::bigint as blocks, sum(case when files > 1 then n else 0 end)::bigint as shared_blocks, count(*) as unique_blocks, sum(n * s)::bigint as bytes, sum((n - 1) * s)::bigint as saved_bytes from p join f using (d) group by 1")
def chunk_sharing(spark, sf):
    b = chunking.fixed_blocks(_objects(spark, sf), ["doc_id"], "data", 256)
    b = b.select("doc_id", F.sha2("block", 256).alias("digest"), F.octet_length("block").alias("size"))
    return chunking.sharing(b, "doc_id", "digest", "size")
