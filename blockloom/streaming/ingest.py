"""Structured Streaming forms: file ingest, keyed counters, first-seen filters, rate limits, range trackers and tees.

State lives in the state store under the query's checkpoint, so a restart goes on where it stopped. Event-time windows are an extension
of ours (``windowed``); the other functions follow the batch operators of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from blockloom.operators.govern import take_tokens


def read_files(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1, kind: str = "parquet", glob: str | None = None) -> DataFrame:
    """Arriving files as a stream; ``files_per_trigger`` bounds what is in flight (back-pressure)."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind)
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def _out(pdfs: list[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    return pd.concat(pdfs)[columns] if pdfs else pd.DataFrame(columns=columns)


def running_totals(stream: DataFrame, key: str, size: str) -> DataFrame:
    """(key, count, bytes) after each trigger for the keys it touched."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, b = state.get if state.exists else (0, 0)
        for p in pdfs:
            n += len(p)
            b += int(p[size].sum())
        state.update((n, b))
        yield pd.DataFrame({key: [k[0]], "count": [n], "bytes": [b]})

    return stream.select(key, F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias(size)).groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kind}, count bigint, bytes bigint", "n bigint, b bigint", "update", GroupStateTimeout.NoTimeout
    )


def first_seen(stream: DataFrame, key: str, at: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; with an event time the state of keys older than the delay is dropped."""
    if at is None:
        return stream.dropDuplicates([key])
    d = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", delay)
    return d.dropDuplicatesWithinWatermark([key]).drop("__at")


def rate_limited(stream: DataFrame, key: str, at_ms: str, tokens: str, rate: int) -> DataFrame:
    """(key, at_ms, tokens, allowed): one token bucket per key, kept between triggers; rows of a trigger are taken in order of time."""
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p = _out(list(pdfs), [at_ms, tokens]).sort_values([at_ms, tokens])
        s = tuple(state.get) if state.exists else (rate, int(p[at_ms].iloc[0]) if len(p) else 0)
        allowed = []
        for now, n in zip(p[at_ms], p[tokens]):
            s, ok = take_tokens(s, int(now), int(n), rate)
            allowed.append(ok)
        state.update(s)
        yield pd.DataFrame({key: [k[0]] * len(p), at_ms: p[at_ms].to_numpy(), tokens: p[tokens].to_numpy(), "allowed": allowed})

    return stream.select(key, at_ms, tokens).groupBy(key).applyInPandasWithState(
        step, f"`{key}` {types[key]}, `{at_ms}` {types[at_ms]}, `{tokens}` {types[tokens]}, allowed boolean", "have bigint, last bigint", "append", GroupStateTimeout.NoTimeout
    )


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def range_tracker(stream: DataFrame, key: str) -> DataFrame:
    """(key, spans, covered) after each trigger: the merged spans received so far; a state that can't be read counts as empty."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        try:
            have = [tuple(map(int, s.split("-"))) for s in state.get[0].split(",") if s] if state.exists else []
        except ValueError:
            have = []
        for p in pdfs:
            have += [(int(a), int(b)) for a, b in zip(p["start"], p["end"]) if a <= b]
        have = merge_spans(have)
        text = ",".join(f"{a}-{b}" for a, b in have)
        state.update((text,))
        yield pd.DataFrame({key: [k[0]], "spans": [text], "covered": [sum(b - a + 1 for a, b in have)]})

    return stream.select(key, "start", "end").where("start is not null and end is not null").groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kind}, spans string, covered bigint", "spans string", "update", GroupStateTimeout.NoTimeout
    )


def windowed(stream: DataFrame, at: str, size: str, slide: str | None, delay: str, keys: list[str], value: str) -> DataFrame:
    """(window, keys..., n, total): tumbling or sliding event-time windows; rows later than the delay are dropped (extension)."""
    d = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", delay)
    w = F.window("__at", size, slide) if slide else F.window("__at", size)
    return d.groupBy(w.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def tee(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Each trigger's rows are computed once (written to the shared folder) and given to all sinks; starts the query."""
    from blockloom.workspace import written

    def both(batch: DataFrame, epoch: int) -> None:
        kept = written(batch, "tee")
        for s in sinks:
            s(kept, epoch)

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Processes what is there and returns the result so far. Update mode keeps every trigger's rows with its number, ``trigger``."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("trigger", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{path}/trigger_id={epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path).drop("trigger_id")
