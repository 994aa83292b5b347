"""Byte columns and byte streams into blocks: fixed, delimited and content-defined.

Fixed blocks and re-blocking stay in generated JVM code. Delimiters with bounds and content-defined cuts run on Arrow batches, one
object at a time; cuts depend on an object's bytes only, never on how they arrived. Null data has no blocks, empty data none either.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_BLOCK = 16 * 1024 * 1024
M32 = 0xFFFFFFFF


def clamp(n: int) -> int:
    return max(1, min(n, MAX_BLOCK))


def fixed_blocks(df: DataFrame, keys: Sequence[str], data: str, n: int) -> DataFrame:
    """(keys..., block_index, block_start, block_end, block): blocks of ``n`` bytes (kept within 1 byte and 16 MiB) and a tail."""
    n = clamp(n)
    d = df.where(F.octet_length(data) > 0).select(*keys, F.col(data).alias("__d"), F.octet_length(data).cast("bigint").alias("__n"))
    d = d.withColumn("block_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / n))))
    start = F.col("block_index") * n
    return d.select(*keys, "block_index", start.alias("block_start"), (F.least(start + n, F.col("__n")) - 1).alias("block_end"), F.substring("__d", (start + 1).cast("int"), F.lit(n)).alias("block"))


def rechunk(df: DataFrame, part: Sequence[str], order: Sequence[str], data: str, n: int, segments: int = 64) -> DataFrame:
    """(part..., block_index, block): a stream of chunks re-blocked to exactly ``n`` bytes and a tail. ``part`` names one column at
    least, ``order`` is unique in a stream.

    Where a chunk begins is summed over the lengths alone, in ``segments`` parts of a stream at a time; the bytes stay where they are until
    each chunk is cut at the block bounds it crosses, and a block is joined from its pieces. So no stream is gathered in one place.
    """
    from blockloom.operators.transduce import running_sum

    n = clamp(n)
    d = df.where(F.octet_length(data) > 0).select(*part, *order, F.col(data).alias("__d"), F.octet_length(data).cast("bigint").alias("__n"))
    keys = [*part, *order]
    # segments follow the order: equal widths of its first column if that is a number or time, one segment otherwise
    first = dict(d.dtypes)[order[0]]
    at = F.col(order[0]).cast("double") if first in ("tinyint", "smallint", "int", "bigint", "double", "float") else F.unix_micros(F.col(order[0]).cast("timestamp")).cast("double") if first in ("timestamp", "timestamp_ntz") else F.lit(0.0)
    lengths = d.select(*keys, "__n", at.alias("__at"))
    ends = lengths.groupBy(*part).agg(F.min("__at").alias("__lo"), F.max("__at").alias("__hi"))
    ends = ends.select(*[F.col(k).alias(f"__p{i}") for i, k in enumerate(part)], "__lo", "__hi")
    same = lambda left, right, cols, p: [left[k].eqNullSafe(right[f"{p}{i}"]) for i, k in enumerate(cols)]
    lengths = lengths.join(ends, same(lengths, ends, part, "__p"))
    seg = F.coalesce(F.floor(F.try_divide(F.col("__at") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * (segments - 1)), F.lit(0))
    lengths = running_sum(lengths, part, order, {"__o": F.col("__n")}, seg)
    starts = lengths.select(*[F.col(k).alias(f"__q{i}") for i, k in enumerate(keys)], (F.col("__o") - F.col("__n")).cast("bigint").alias("__o"))
    d = d.join(starts, same(d, starts, keys, "__q")).select(*keys, "__d", "__n", "__o")
    d = d.withColumn("block_index", F.explode(F.sequence(F.floor(F.col("__o") / n), F.floor((F.col("__o") + F.col("__n") - 1) / n))))
    lo = F.greatest(F.col("block_index") * n, F.col("__o"))
    hi = F.least((F.col("block_index") + 1) * n, F.col("__o") + F.col("__n"))
    piece = F.substring("__d", (lo - F.col("__o") + 1).cast("int"), (hi - lo).cast("int"))
    g = d.select(*part, "block_index", lo.alias("__at"), F.hex(piece).alias("__p")).groupBy(*part, "block_index").agg(F.array_sort(F.collect_list(F.struct("__at", "__p"))).alias("__b"))
    return g.select(*part, "block_index", F.unhex(F.array_join(F.transform("__b", lambda x: x["__p"]), "")).alias("block"))


def rechunk_summary(df: DataFrame, part: Sequence[str], data: str, n: int) -> DataFrame:
    """(part..., total_bytes, block_count, fill): block_count has only full blocks, the tail isn't counted; fill is 0 at the end."""
    n = clamp(n)
    s = df.groupBy(*part).agg(F.coalesce(F.sum(F.octet_length(data)), F.lit(0)).cast("bigint").alias("total_bytes"))
    return s.select(*part, "total_bytes", F.floor(F.col("total_bytes") / n).alias("block_count"), F.lit(0).alias("fill"))


def split_lines(df: DataFrame, keys: Sequence[str], text: str, delimiter: str = "\n") -> DataFrame:
    """(keys..., block_index, block): a text split at a delimiter that is left out, empty pieces dropped. JVM only."""
    quoted = "".join(f"\\x{ord(c):02x}" if ord(c) < 128 else c for c in delimiter)
    pieces = F.filter(F.split(text, quoted, -1), lambda x: x != "")
    return df.select(*keys, F.posexplode(pieces).alias("block_index", "block"))


def delimiter_cuts(data: bytes, delim: bytes, include: bool, lo: int, hi: int) -> list[bytes]:
    """Blocks cut after a delimiter once ``lo`` bytes (with the delimiter) are there, or at ``hi`` bytes.

    The matcher starts afresh after every cut: a delimiter that a cut at ``hi`` goes through is missed. Without ``include`` the
    delimiter is taken off where it made the cut; empty blocks are dropped.
    """
    if not delim:
        raise ValueError("empty delimiter")
    lo = max(1, lo)
    hi = max(lo, min(hi, MAX_BLOCK))
    out, start, n, k = [], 0, len(data), len(delim)
    while start < n:
        # the first delimiter of the block that ends at lo bytes or later
        at = data.find(delim, max(start, start + lo - k))
        end = at + k if at >= 0 else n + 1
        if end - start > hi or at < 0:
            end, cut_by = min(start + hi, n), False
        else:
            cut_by = True
        block = data[start : end - k] if cut_by and not include else data[start:end]
        if block:
            out.append(block)
        start = end
    return out


# fixed values: the generating rule of the gear table and the bounds of the masks shape the cuts
def gear_table() -> np.ndarray:
    """The 256 words of the rolling hash, from their generating rule."""
    x, out = 0x9E3779B9, []
    for i in range(256):
        x ^= (i * 0x85EBCA6B) & M32
        x = (((x << 13) | (x >> 19)) & M32) * 0xC2B2AE35 & M32
        out.append(x)
    return np.array(out, np.uint32)


def cdc_masks(avg: int) -> tuple[int, int]:
    """(mask below the average, mask from the average on): the first has fewer bits, so cuts come more easily below the average."""
    bits = max(avg, 1).bit_length() - 1
    return (1 << max(6, min(18, bits - 1))) - 1, (1 << max(8, min(20, bits))) - 1


def cdc_bounds(lo: int, avg: int, hi: int) -> tuple[int, int, int]:
    lo = max(1, lo)
    hi = max(lo, min(hi, MAX_BLOCK))
    return lo, max(lo, min(avg, hi)), hi


def fast_cdc(data: bytes | pa.Buffer, lo: int, avg: int, hi: int, gear: np.ndarray | None = None) -> list[int]:
    """Block sizes. The low k bits of the hash depend on the last k bytes only, so all candidate cuts come from one vector pass; the
    greedy choice then only walks the candidates. If ``lo`` is less than the mask's bits, the reset at a cut shows and bytes are walked."""
    lo, avg, hi = cdc_bounds(lo, avg, hi)
    below, from_avg = cdc_masks(avg)
    g = gear_table() if gear is None else gear
    n = len(memoryview(data))
    if lo < from_avg.bit_length():
        return _cdc_bytes(bytes(data), lo, avg, hi, below, from_avg, g)
    easy, hard = (c.tolist() for c in _candidates(data, g, np.add, below, from_avg))
    sizes, start, i, j = [], 0, 0, 0
    while start < n:
        end = min(start + hi, n)
        i = bisect_left(easy, start + lo, i)
        if i < len(easy) and easy[i] < min(start + avg, end):
            end = easy[i]
        else:
            j = bisect_left(hard, start + avg, j)
            if j < len(hard) and hard[j] < end:
                end = hard[j]
        sizes.append(end - start)
        start = end
    return sizes


def _candidates(data: bytes, table: np.ndarray, op: np.ufunc, few: int, many: int, step: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Ends at which the shift-and-``op`` hash has zeros under the mask ``few``, and under ``many``, which has all its bits.

    The hash's low bits come from windows that double: 1, 2, 4 ... bytes up to the bits of the mask. Stretches of ``step`` bytes, each
    with the bytes before it that still count, stay in the processor's cache.
    """
    bits = many.bit_length()
    kind = np.uint16 if bits <= 16 else np.uint32
    small, raw = table.astype(kind), np.frombuffer(data, np.uint8)
    easy, hard = [], []
    for at in range(0, len(raw), step):
        lead = min(at, 32)
        h = small[raw[at - lead : at + step]]
        w = 1
        while w < min(bits, len(h)):
            op(h[w:], h[:-w] << kind(w), out=h[w:])
            w *= 2
        h = h[lead:]
        e = np.flatnonzero((h & kind(few)) == 0)
        hard.append(e[(h[e] & kind(many)) == 0] + (at + 1))
        easy.append(e + (at + 1))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *easy]), np.concatenate([none, *hard])


def _cdc_bytes(data: bytes, lo: int, avg: int, hi: int, below: int, from_avg: int, g: np.ndarray) -> list[int]:
    table, sizes, h, n = g.tolist(), [], 0, 0
    for b in data:
        h = ((h << 1) + table[b]) & M32
        n += 1
        if n >= hi or (n >= lo and h & (below if n < avg else from_avg) == 0):
            sizes.append(n)
            h = n = 0
    return sizes + [n] if n else sizes


def anchor_ends(data: bytes, anchor: bytes) -> list[int]:
    """Ends of the anchor's matches by a matcher that, on a byte that breaks the match, starts again at that byte only. Cuts don't
    touch the matcher, so its matches depend on the data alone; between first bytes the search jumps."""
    out, k = [], len(anchor)
    at = data.find(anchor[:1])
    while at >= 0:
        n = 1
        while n < k and at + n < len(data) and data[at + n] == anchor[n]:
            n += 1
        if n == k:
            out.append(at + k)
        # the byte after a whole match, or the byte that broke it, is where the next match may begin
        at = data.find(anchor[:1], at + n)
    return out


def anchored_cdc(data: bytes, lo: int, avg: int, hi: int, anchor: bytes = b"") -> list[tuple[int, str]]:
    """(size, reason) of the xor-shift chunker: reason anchor, max, roll or eof, in that priority.

    roll = ((roll << 1) ^ byte) mod 2^24 since the last cut; a block is cut where its low bits are 0. The low bits depend on as many
    last bytes, so where ``lo`` is no less than that all candidates come from one vector pass; else bytes are walked.
    """
    lo, avg, hi = cdc_bounds(lo, avg, hi)
    bits = max(1, (avg - 1).bit_length()) - 1
    ends = np.array(anchor_ends(data, anchor) if anchor else [], np.int64)
    if lo < bits:
        return _anchored_bytes(data, lo, hi, (1 << bits) - 1, set(ends.tolist()))
    mask = (1 << bits) - 1
    rolls = _candidates(data, np.arange(256), np.bitwise_xor, mask, mask)[1]
    out, start, n = [], 0, len(data)
    while start < n:
        nearest = lambda x: int(x[i]) if (i := np.searchsorted(x, start + lo)) < len(x) else n + hi  # noqa: E731, B023
        a, m, r = nearest(ends), start + hi, nearest(rolls)
        end = min(a, m, r)
        if end > n:
            out.append((n - start, "eof"))
            break
        out.append((end - start, "anchor" if end == a else "max" if end == m else "roll"))
        start = end
    return out


def _anchored_bytes(data: bytes, lo: int, hi: int, mask: int, ends: set[int]) -> list[tuple[int, str]]:
    roll = n = 0
    out = []
    for i, b in enumerate(data, 1):
        n += 1
        roll = ((roll << 1) ^ b) & 0xFFFFFF
        why = "anchor" if i in ends and n >= lo else "max" if n >= hi else "roll" if n >= lo and roll & mask == 0 else None
        if why:
            out.append((n, why))
            n = roll = 0
    return [*out, (n, "eof")] if n else out


def _per_object(df: DataFrame, key: str, data: str, cut, reason: bool = False) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    extra = ", reason string" if reason else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, index, start, block, why = [], [], [], [], []
            for i, d in enumerate(b.column(1).to_pylist()):
                for k, (s, piece, w) in enumerate(cut(bytes(d))):
                    at.append(i)
                    index.append(k)
                    start.append(s)
                    block.append(piece)
                    why.append(w)
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(index, pa.int64()), pa.array(start, pa.int64()), pa.array(block, pa.binary())]
            names = [key, "block_index", "block_start", "block"]
            yield pa.record_batch(cols + [pa.array(why, pa.string())] * reason, names + ["reason"] * reason)

    src = df.where(F.octet_length(data) > 0).select(key, F.col(data).cast("binary").alias("__d"))
    return src.mapInArrow(run, f"`{key}` {kind}, block_index bigint, block_start bigint, block binary{extra}")


def delimiter_blocks(df: DataFrame, key: str, data: str, delim: bytes, include: bool = True, lo: int = 1, hi: int = MAX_BLOCK) -> DataFrame:
    """(key, block_index, block_start, block); block_start counts kept bytes only where delimiters are left out."""
    if not delim:
        raise ValueError("empty delimiter")

    def cut(d: bytes):
        at = 0
        for p in delimiter_cuts(d, delim, include, lo, hi):
            yield at, p, None
            at += len(p)

    return _per_object(df, key, data, cut)


def cdc_blocks(df: DataFrame, key: str, data: str, lo: int = 256, avg: int = 1024, hi: int = 4096) -> DataFrame:
    """(key, block_index, block_start, block) by the gear hash. A batch's blocks are its own bytes under new offsets: nothing is copied."""
    gear = gear_table()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            objects = b.column(1)
            _, bounds, data = objects.buffers()
            at = np.frombuffer(bounds, np.int32)[objects.offset : objects.offset + len(objects) + 1].astype(np.int64)
            cuts = [np.cumsum(fast_cdc(data.slice(lo_, hi_ - lo_), lo, avg, hi, gear)) for lo_, hi_ in zip(at[:-1].tolist(), at[1:].tolist())]
            n = np.array([len(c) for c in cuts], np.int64)
            owner = np.repeat(np.arange(len(cuts)), n)
            ends = np.concatenate([np.zeros(0, np.int64), *cuts])
            index = np.arange(len(ends)) - np.repeat(np.cumsum(n) - n, n)
            starts = np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1]])
            starts[index == 0] = 0
            offsets = np.concatenate([at[:1], ends + at[owner]]).astype(np.int32)
            blocks = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), data])
            yield pa.record_batch([b.column(0).take(pa.array(owner)), pa.array(index), pa.array(starts), blocks], [key, "block_index", "block_start", "block"])

    src = df.where(F.octet_length(data) > 0).select(key, F.col(data).cast("binary").alias("__d"))
    return src.mapInArrow(run, f"`{key}` {kind}, block_index bigint, block_start bigint, block binary")


def anchored_blocks(df: DataFrame, key: str, data: str, lo: int = 256, avg: int = 1024, hi: int = 4096, anchor: bytes = b"") -> DataFrame:
    """(key, block_index, block_start, block, reason) by the xor-shift hash with an optional anchor."""

    def cut(d: bytes):
        at = 0
        for n, why in anchored_cdc(d, lo, avg, hi, anchor):
            yield at, d[at : at + n], why
            at += n

    return _per_object(df, key, data, cut, reason=True)


def ingest_events(blocks: DataFrame, key: str) -> DataFrame:
    """Block and final events of :func:`anchored_blocks`: running totals up to and with the block (the last block's own bytes count
    once), the block's digest, and one final row with the digest of the whole."""
    w = Window.partitionBy(key).orderBy("block_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.octet_length("block").cast("bigint")
    ev = blocks.select(
        key, F.lit("block").alias("kind"), "block_index", F.col("block_start").alias("offset"), n.alias("size"), "reason", F.sum(n).over(w).alias("total_bytes"), (F.col("block_index") + 1).alias("total_blocks"), F.sha2("block", 256).alias("digest")
    )
    g = blocks.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("b"), F.array_sort(F.collect_list(F.struct("block_index", F.hex("block").alias("x")))).alias("c"))
    whole = F.sha2(F.unhex(F.array_join(F.transform("c", lambda x: x["x"]), "")), 256)
    fin = g.select(key, F.lit("final").alias("kind"), F.col("k").alias("block_index"), F.col("b").alias("offset"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("string").alias("reason"), F.col("b").alias("total_bytes"), F.col("k").alias("total_blocks"), whole.alias("digest"))
    return ev.unionByName(fin)


def sharing(blocks: DataFrame, key: str, digest: str, size: str) -> DataFrame:
    """(key, blocks, shared_blocks, unique_blocks, bytes, saved_bytes): per file how much its blocks occur elsewhere or again."""
    per = blocks.groupBy(digest, key).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("s"))
    files = per.groupBy(digest).agg(F.count(F.lit(1)).alias("files"))
    j = per.join(files, digest)
    return j.groupBy(key).agg(
        F.sum("n").alias("blocks"),
        F.sum(F.when(F.col("files") > 1, F.col("n")).otherwise(0)).alias("shared_blocks"),
        F.count(F.lit(1)).alias("unique_blocks"),
        F.sum(F.col("n") * F.col("s")).cast("bigint").alias("bytes"),
        F.sum((F.col("n") - 1) * F.col("s")).cast("bigint").alias("saved_bytes"),
    )


def whole_frames(df: DataFrame, part: Sequence[str], order: Sequence[str], data: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(frames, left_over): only whole frames of ``n`` bytes, and what is kept back of each stream."""
    b = rechunk(df, part, order, data, n)
    whole = F.octet_length("block") == clamp(n)
    return b.where(whole), b.where(~whole).select(*part, F.col("block").alias("left_over"))
