"""Ordered stream operators over tables.

A stream is the rows of one value of ``part`` in the order of ``order``, which must be total within a stream. Every function takes
and returns DataFrames, keeps all columns and adds its own; the order of the input rows never matters. Null keys are a stream of
their own. Operators that hold back a last element ("flush") emit it as a row of its own where the docstring says so.

Counts and sums take ``segment``, an expression that never falls along a stream (a day, a range of sequence numbers): a stream with a
third of all rows is then summed in segments by many tasks and the segments' totals are added in a second step.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Cols = Sequence[str]
#: Rows of an Arrow batch that a state machine gives out.
OUT_ROWS = 4096


def _order(order: Cols) -> list[Column]:
    return [F.col(c) for c in order]


def upto(part: Cols, order: Cols):
    return Window.partitionBy(*part).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ordinal(df: DataFrame, part: Cols, order: Cols, name: str = "ordinal") -> DataFrame:
    """0-based position in the stream."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*_order(order))).cast("bigint") - 1)


def running_sum(df: DataFrame, part: Cols, order: Cols, sums: dict[str, Column], segment: Column | None = None) -> DataFrame:
    """fold1/accumulate for additive states: each row with the sums up to and including it; nulls add nothing."""
    if segment is None:
        w = upto(part, order)
        return df.withColumns({n: F.coalesce(F.sum(e).over(w), F.lit(0)) for n, e in sums.items()})
    d = df.withColumns({f"__{n}": e for n, e in sums.items()} | {"__seg": segment})
    keys = [*part, "__seg"]
    inner = upto(keys, order)
    before = Window.partitionBy(*part).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys).agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in sums])
    totals = totals.withColumns({f"__b_{n}": F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)) for n in sums})
    t = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[f"__b_{n}" for n in sums])
    on = None
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        on = c if on is None else on & c
    d = d.join(t, on).withColumns({n: F.coalesce(F.sum(f"__{n}").over(inner), F.lit(0)) + F.col(f"__b_{n}") for n in sums})
    return d.drop("__seg", *[f"__k{i}" for i in range(len(keys))], *[f"__{n}" for n in sums], *[f"__b_{n}" for n in sums])


def counter(df: DataFrame, part: Cols, order: Cols, name: str = "count", segment: Column | None = None) -> DataFrame:
    return running_sum(df, part, order, {name: F.lit(1).cast("bigint")}, segment)


def byte_counter(df: DataFrame, part: Cols, order: Cols, data: str, name: str = "bytes", segment: Column | None = None) -> DataFrame:
    return running_sum(df, part, order, {name: F.octet_length(data).cast("bigint")}, segment)


def sliding(df: DataFrame, part: Cols, order: Cols, value: str, n: int, name: str = "window") -> DataFrame:
    """The last ``n`` values including the current one; n below 1 counts as 1."""
    w = Window.partitionBy(*part).orderBy(*_order(order)).rowsBetween(-(max(1, n) - 1), Window.currentRow)
    return df.withColumn(name, F.collect_list(value).over(w))


def dedup(df: DataFrame, part: Cols, order: Cols, key: Cols) -> DataFrame:
    """The first row of each key of a stream. Only the first positions are compared, on the map side where possible."""
    first = df.groupBy(*part, *key).agg(F.min(F.struct(*order)).alias("__first"))
    cols = [*part, *key]
    f = first.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(cols)], *[F.col(f"__first.{o}").alias(f"__o{i}") for i, o in enumerate(order)])
    on = F.lit(True)
    for i, c in enumerate(cols):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    for i, o in enumerate(order):
        on = on & F.col(o).eqNullSafe(F.col(f"__o{i}"))
    return df.join(f, on, "left_semi")


def dedup_summary(df: DataFrame, part: Cols, key: Cols) -> DataFrame:
    """(part..., unique_count, duplicate_count)"""
    per = df.groupBy(*part, *key).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*part).agg(F.count(F.lit(1)).alias("unique_count"), (F.sum("n") - F.count(F.lit(1))).alias("duplicate_count"))


def batches(df: DataFrame, part: Cols, order: Cols, value: str, n: int) -> DataFrame:
    """(part..., batch, items): groups of ``n`` in order; the last one may be short."""
    d = ordinal(df, part, order, "__i").withColumn("batch", F.floor(F.col("__i") / max(1, n)).cast("bigint"))
    g = d.groupBy(*part, "batch").agg(F.array_sort(F.collect_list(F.struct("__i", F.col(value).alias("v")))).alias("__b"))
    return g.select(*part, "batch", F.transform("__b", lambda x: x["v"]).alias("items"))


def run_groups(df: DataFrame, part: Cols, order: Cols, key: str) -> DataFrame:
    """(part..., run, key, n): consecutive equal keys, as a run-length coding; null equals null."""
    w = Window.partitionBy(*part).orderBy(*_order(order))
    change = (~F.col(key).eqNullSafe(F.lag(key).over(w))) | (F.row_number().over(w) == 1)
    d = df.withColumn("__c", change.cast("int")).withColumn("run", F.sum("__c").over(upto(part, order)))
    return d.groupBy(*part, "run", key).agg(F.count(F.lit(1)).alias("n"))


def ema(df: DataFrame, part: Cols, order: Cols, value: str, alpha: float, start: float | None = None, name: str = "ema") -> DataFrame:
    """(part..., name, samples): the moving average after the last value, ``alpha`` kept within 0.001 and 0.999.

    Without ``start`` the first sample seeds it; with ``start`` (a rate) the first sample is averaged into it. Null values are left
    out. A stream is folded as one array, so it must fit a row; the weights fade as (1 - alpha) ** age, and streams too long for that
    can be cut to their last few thousand samples without a change in the first 12 digits.
    """
    a = min(0.999, max(0.001, alpha))
    g = df.where(F.col(value).isNotNull()).groupBy(*part).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("__v")))).alias("__s"))
    v = F.transform("__s", lambda x: x["__v"])
    seed, rest = (v[0], F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0)))) if start is None else (F.lit(float(start)), v)
    return g.select(*part, F.aggregate(rest, seed, lambda e, x: e * (1 - a) + x * a).alias(name), F.size(v).alias("samples"))


def ema_running(df: DataFrame, part: Cols, order: Cols, value: str, alpha: float, name: str = "ema") -> DataFrame:
    """Every row with the moving average up to it; rows without a value are left out. One pass over each sorted stream."""
    a = min(0.999, max(0.001, alpha))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def machine(rows):
        state = None
        for *at, v in rows:
            state = float(v) if state is None else state * (1 - a) + float(v) * a
            yield (*at, v, state)

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in [*order, value]), f"`{name}` double"])
    return fold_emit(df.where(F.col(value).isNotNull()), part, order, [*order, value], schema, machine)


def min_max(df: DataFrame, part: Cols, value: str) -> DataFrame:
    return df.groupBy(*part).agg(F.min(value).alias("min"), F.max(value).alias("max"))


def bomb_guard(df: DataFrame, part: Cols, order: Cols, size: Column, limit: int, segment: Column | None = None) -> DataFrame:
    """Rows up to the limit: the row that crosses it and all later ones go (sizes aren't negative, so a running sum is the latch)."""
    return running_sum(df, part, order, {"total_seen": size.cast("bigint")}, segment).where(F.col("total_seen") <= limit)


def bomb_summary(df: DataFrame, part: Cols, size: Column, limit: int) -> DataFrame:
    """(part..., total_seen, rejected, max_bytes); total_seen includes what was dropped."""
    s = df.groupBy(*part).agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0)).alias("total_seen"))
    return s.withColumn("rejected", F.col("total_seen") > limit).withColumn("max_bytes", F.lit(limit).cast("bigint"))


def reservoir(df: DataFrame, part: Cols, key: Cols, n: int, seed: int = 7) -> DataFrame:
    """A uniform sample of ``n`` rows per stream: those with the smallest hash of (key, seed). Another sample than an Algorithm R run
    would give, but repeatable, and the top n are kept per task before anything is shuffled."""
    w = Window.partitionBy(*part).orderBy("__h", *key)
    d = df.withColumn("__h", F.xxhash64(*key, F.lit(seed))).withColumn("__n", F.row_number().over(w))
    return d.where(F.col("__n") <= max(0, n)).drop("__h", "__n")


def zip_per_step(left: DataFrame, right: DataFrame, keys: Cols, step: str = "step", idx: str = "idx") -> DataFrame:
    """Fan-out of n:m emitters on the same input: outputs are paired within each step and the longer side's rest is dropped."""
    return left.join(right, [*keys, step, idx], "inner")


def zip_across_steps(left: DataFrame, right: DataFrame, part: Cols, left_order: Cols, right_order: Cols, name: str = "pair") -> DataFrame:
    """Buffered fan-out: the n-th output of one side meets the n-th of the other, whatever steps they came from; surplus is dropped."""
    return ordinal(left, part, left_order, name).join(ordinal(right, part, right_order, name), [*part, name], "inner")


def choice(df: DataFrame, part: Cols, order: Cols, is_right: Column, sums_left: dict[str, Column], sums_right: dict[str, Column]) -> DataFrame:
    """Left and right rows routed to states of their own: ``branch`` and the running sums of that branch (the other's are null)."""
    d = df.withColumn("branch", F.when(is_right, "right").otherwise("left"))
    w = upto([*part, "branch"], order)
    out = {n: F.when(F.col("branch") == b, F.sum(e).over(w)) for b, s in (("left", sums_left), ("right", sums_right)) for n, e in s.items()}
    return d.withColumns(out)


def merge_structs(left: Column, right: Column, left_fields: Cols, right_fields: Cols) -> Column:
    """Two named states as one. A name that both have is an error: nothing is overwritten silently."""
    clash = sorted(set(left_fields) & set(right_fields))
    if clash:
        raise ValueError(f"both states have {clash}")
    return F.struct(*[left[f].alias(f) for f in left_fields], *[right[f].alias(f) for f in right_fields])


def window_annotate(df: DataFrame, part: Cols, order: Cols, data: str, window: int) -> DataFrame:
    """(.., byte_sum, window_total, flagged) per frame: rolling byte sums of the last ``window`` frames of an input batch; flagged when
    the frame's sum is even or it has a byte of 128 or more."""
    @F.pandas_udf("s bigint, hi boolean")
    def sums(frames: pd.Series) -> pd.DataFrame:
        b = [np.frombuffer(x or b"", np.uint8) for x in frames]
        return pd.DataFrame({"s": [int(x.sum(dtype=np.int64)) for x in b], "hi": [bool((x >= 128).any()) for x in b]})

    d = df.withColumn("__b", sums(F.col(data).cast("binary"))).withColumn("byte_sum", F.col("__b.s"))
    w = Window.partitionBy(*part).orderBy(*_order(order)).rowsBetween(-(max(1, window) - 1), Window.currentRow)
    return d.withColumn("window_total", F.sum("byte_sum").over(w)).withColumn("flagged", (F.col("byte_sum") % 2 == 0) | F.col("__b.hi")).drop("__b")


def hash31(data: str) -> Column:
    """The 31-polynomial hash of bytes, signed 32 bits, starting from 1."""
    hexed = F.hex(data)
    vals = F.when(F.octet_length(data) > 0, F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.aggregate(vals, F.lit(1).cast("bigint"), lambda h, b: wrap(h * 31 + F.when(b >= 128, b - 256).otherwise(b))).cast("int")


def short_circuit(df: DataFrame, part: Cols, order: Cols, data: str, marker: bytes, reason: str) -> DataFrame:
    """(part..., stopped, reason, frames, hashes): a batch of frames stops when their bytes joined hold the marker; an empty marker
    never matches."""
    hexed = F.array_sort(F.collect_list(F.struct(*order, F.hex(data).alias("__x"), hash31(data).alias("__h"))))
    g = df.groupBy(*part).agg(hexed.alias("__f"))
    joined = F.array_join(F.transform("__f", lambda x: x["__x"]), "")
    m = marker.hex().upper()
    # a match must begin on a byte: at an odd 1-based place of the hexadecimal text
    n = F.length(joined) - len(m)
    starts = F.when(n >= 0, F.sequence(F.lit(0), F.floor(n / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    hit = F.exists(starts, lambda i: F.substring(joined, i * 2 + 1, F.lit(len(m))) == m) if m else F.lit(False)
    return g.select(*part, hit.alias("stopped"), F.when(hit, reason).alias("reason"), F.size("__f").alias("frames"), F.transform("__f", lambda x: x["__h"]).alias("hashes"))


# fixed values: leading bytes of known types
MAGIC = {"25504446": "application/pdf", "504B0304": "application/zip", "1F8B": "application/gzip"}


def sniff(data: Column) -> Column:
    h = F.hex(F.substring(data, 1, 16))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for magic, mime in MAGIC.items():
        out = out.when(h.startswith(magic), mime)
    return out


def telemetry_steps(df: DataFrame, part: Cols, order: Cols, data: str, max_bytes: int, large_cutoff: int = 1 << 20) -> DataFrame:
    """One row per chunk: route, ordinal, running bytes and chunks, type hint from the first 16 bytes so far, halted."""
    d = ordinal(df, part, order, "__i").withColumn("__n", F.octet_length(data).cast("bigint"))
    w = upto(part, order)
    # the first 16 prefixes that aren't empty are enough for 16 bytes; nth_value is null until its row is reached
    prefix = F.nullif(F.hex(F.substring(F.col(data), 1, 16)), F.lit(""))
    head = F.concat_ws("", *[F.nth_value(prefix, k, ignoreNulls=True).over(w) for k in range(1, 17)])
    d = d.withColumn("bytes", F.sum("__n").over(w)).withColumn("__head", F.unhex(F.substring(head, 1, 32)))
    return d.select(
        *part,
        *order,
        F.when(F.col("__n") >= max(1, large_cutoff), "large").otherwise("small").alias("route"),
        (F.col("__i") + 1).alias("ordinal"),
        "bytes",
        (F.col("__i") + 1).alias("chunks"),
        sniff(F.col("__head")).alias("mime_hint"),
        ((F.lit(max_bytes) > 0) & (F.col("bytes") > max_bytes)).alias("halted"),
    )


def telemetry_final(df: DataFrame, part: Cols, order: Cols, data: str) -> DataFrame:
    """One row per stream: bytes, chunks, type hint, SHA-256 of the whole. Chunks pass one after the other; null ones have no bytes."""

    def machine(rows):
        h, n, chunks, head = hashlib.sha256(), 0, 0, b""
        for (d,) in rows:
            chunks += 1
            if d:
                h.update(d)
                n += len(d)
                head = (head + d[: 16 - len(head)]) if len(head) < 16 else head
        yield n, chunks, head, h.hexdigest()

    d = df.withColumn(data, F.col(data).cast("binary"))
    g = fold_emit(d, part, order, [data], "bytes bigint, chunks bigint, head binary, sha256 string", machine)
    return g.select(*part, "bytes", "chunks", sniff(F.col("head")).alias("mime_hint"), "sha256")


def throughput(df: DataFrame, part: Cols, size: Column, at: str) -> DataFrame:
    """(part..., bytes, chunks, elapsed_seconds, bytes_per_second) by event time; null rate where no time passed."""
    g = df.groupBy(*part).agg(F.sum(size).cast("bigint").alias("bytes"), F.count(F.lit(1)).alias("chunks"), (F.unix_micros(F.max(F.col(at).cast("timestamp"))) - F.unix_micros(F.min(F.col(at).cast("timestamp")))).alias("__us"))
    s = F.col("__us") / 1e6
    return g.select(*part, "bytes", "chunks", s.alias("elapsed_seconds"), F.try_divide("bytes", s).alias("bytes_per_second"))


def scan_with_tail(df: DataFrame, part: Cols, order: Cols, sums: dict[str, Column]) -> DataFrame:
    """One output per step, then one flush row per stream (``is_tail``) with the final sums; its order columns are null."""
    steps = running_sum(df, part, order, sums).select(*part, *order, *sums, F.lit(False).alias("is_tail"))
    tail = df.groupBy(*part).agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(n) for n, e in sums.items()])
    types = dict(df.dtypes)
    return steps.unionByName(tail.select(*part, *[F.lit(None).cast(types[o]).alias(o) for o in order], *sums, F.lit(True).alias("is_tail")))


def fold(df: DataFrame, part: Cols, order: Cols, item: Column, init: Column, step, finish=lambda s: s, name: str = "state") -> DataFrame:
    """(part..., state) of any fold: ``step(state, item)`` and ``finish(state)`` are column functions, evaluated in the JVM over a
    stream's items in order. A stream must fit a row; use :func:`running_sum` and its kin where the state only adds up."""
    g = df.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct(*order, item.alias("__v")))).alias("__s"))
    return g.select(*part, F.aggregate("__s", init, lambda acc, x: step(acc, x["__v"]), finish).alias(name))


def fold_emit(df: DataFrame, part: Cols, order: Cols, cols: Cols, schema: str, machine) -> DataFrame:
    """Any state machine with outputs: ``machine(rows)`` gets an iterator over the rows of one stream, in order, as tuples of ``cols``
    and yields output tuples, the last ones after its input has ended (flush). ``schema`` names and types them; the part columns come
    first. Rows are read from sorted partitions an Arrow batch at a time, so a stream may be of any length; it is worked on by one task.
    The slow path: Python per row, for logic that columns can't say."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    full = ", ".join([*(f"`{p}` {types[p]}" for p in part), schema])
    src = df.select(*dict.fromkeys([*part, *order, *cols]))
    src = (src.repartition(*part) if part else src.repartition(1)).sortWithinPartitions(*part, *_order(order))
    arrow = to_arrow_schema(StructType.fromDDL(full))
    n, at = len(part), [src.columns.index(c) for c in cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        batch = lambda: pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        for key, stream in itertools.groupby(rows, lambda r: r[:n]):
            for o in machine(tuple(r[i] for i in at) for r in stream):
                out.append((*key, *o))
                if len(out) >= OUT_ROWS:
                    yield batch()
                    out.clear()
        if out:
            yield batch()

    return src.mapInArrow(run, full)


def hash_stream(df: DataFrame, part: Cols, order: Cols, data: str) -> DataFrame:
    """(part..., digest, hashed_bytes): SHA-256 of each whole stream, chunk by chunk: its bytes are never joined into one value; empty
    streams hash no bytes."""

    def machine(rows):
        h, n = hashlib.sha256(), 0
        for (d,) in rows:
            if d is not None:
                h.update(d)
                n += len(d)
        yield h.hexdigest(), n

    return fold_emit(df, part, order, [data], "digest string, hashed_bytes bigint", machine)


def observed(df: DataFrame, name: str, size: Column | None = None):
    """(df, observation): passes everything through; after an action the observation holds ``rows`` and, with a size, ``bytes``."""
    from pyspark.sql import Observation

    o = Observation(name)
    aggs = [F.count(F.lit(1)).alias("rows")]
    if size is not None:
        aggs.append(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))
    return df.observe(o, *aggs), o


def count_hash_rechunk(df: DataFrame, part: Cols, order: Cols, data: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(blocks, summary): re-blocked streams and per stream its bytes, chunks and digest."""
    from blockloom.operators import chunking

    summary = telemetry_final(df, part, order, data).select(*part, "bytes", "chunks", "sha256")
    return chunking.rechunk(df, part, order, data, n), summary


def ingest_keys(df: DataFrame, part: Cols, order: Cols, data: str, n: int) -> DataFrame:
    """(part..., block_index, block, block_key, size): streams to keyed blocks; empty blocks are skipped."""
    from blockloom.operators import chunking, store

    return store.keyed_blocks(chunking.rechunk(df, part, order, data, n))
