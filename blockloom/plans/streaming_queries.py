"""Streaming operators run to the end of what is there, so that their last state can be checked against a batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.streaming import ingest
from blockloom.workspace import fresh_path, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    kept = table(spark, sf, name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    if kept.inputFiles()[0].endswith(f"/{name}.parquet"):  # the table is one file; a stream reads folders
        return ingest.read_files(spark, sf, schema, glob=f"{name}.parquet")
    return ingest.read_files(spark, f"{sf}/{name}.parquet", schema)


def _span(df: DataFrame, at: str) -> str:
    """The time from the first to the last row: a watermark that waits so long drops none of them, in whatever parts and order they are read."""
    t = F.unix_seconds(F.col(at).cast("timestamp"))
    return f"{(df.agg(F.max(t) - F.min(t)).first()[0] or 0) + 1} seconds"


def _run(stream: DataFrame, mode: str) -> DataFrame:
    p = fresh_path(stream.sparkSession, "stream")
    return ingest.run_once(stream, f"{p}/out", f"{p}/checkpoint", mode)


def _last(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key over all triggers."""
    rest = [c for c in df.columns if c not in keys and c != "trigger"]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "trigger").alias("r"))
    return g.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


@query("select user_id, count(*) as count, sum(octet_length(encode(props)))::bigint as bytes from events group by 1")
def streaming_totals(spark, sf):
    s = _stream(spark, sf, "events").withColumn("n", F.octet_length("props"))
    return _last(_run(ingest.running_totals(s, "user_id", "n"), "update"), ["user_id"])


@query("select distinct event_type from events")
def streaming_first_seen(spark, sf):
    return _run(ingest.first_seen(_stream(spark, sf, "events").select("event_type"), "event_type"), "append").select("event_type")


@query()
def streaming_rate_limit(spark, sf):
    s = _stream(spark, sf, "events").select("user_id", F.expr("unix_millis(cast(ts as timestamp))").alias("ms"), F.floor("value").cast("bigint").alias("n")).where("ms is not null and n is not null")
    return _run(ingest.rate_limited(s, "user_id", "ms", "n", 100), "append").drop("trigger")


@query(
    "with s as (select lower(hex(key)) k, chunk_offset st, chunk_offset + chunk_size - 1 en from blob_data where chunk_size > 0 and key is not null), n as (select *, case when max(en) over (partition by k order by st, en rows between unbounded preceding and 1 preceding) >= st - 1 then 0 else 1 end c from s), i as (select *, sum(c) over (partition by k order by st, en rows unbounded preceding) g from n), m as (select k, g, min(st) st, max(en) en from i group by 1, 2) select k, string_agg(st || '-' || en, ',' order by st) as spans, sum(en - st + 1)::bigint as covered from m group by 1"
)
def streaming_ranges(spark, sf):
    s = _stream(spark, sf, "blob_data").where("chunk_size > 0 and key is not null")
    s = s.select(F.lower(F.hex("key")).alias("k"), F.col("chunk_offset").alias("start"), (F.col("chunk_offset") + F.col("chunk_size") - 1).alias("end"))
    return _last(_run(ingest.range_tracker(s, "k"), "update"), ["k"])


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def streaming_windows(spark, sf):
    delay = _span(table(spark, sf, "events"), "ts")
    w = ingest.windowed(_stream(spark, sf, "events"), "ts", "1 hour", None, delay, ["event_type"], "value")
    d = _last(_run(w.select(F.col("window.start").alias("window_start"), "event_type", "n"), "update"), ["window_start", "event_type"])
    return d.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
