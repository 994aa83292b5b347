"""Tables sorted by a 64-bit hash ``h``, of which a lookup reads only the ranges that it needs.

A lookup notes in a bitmap of 4 KiB which slices of the hash its keys lie in; the driver joins them to a few ranges, and those reach the
scan as pushed-down filters that skip files and row groups. Nothing of the keys themselves goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a sorted table in a file.
FILE_ROWS = 4_000_000
#: Slices of the hash whose use is noted, and the ranges they are joined to for the scan.
SLICE_BITS, RANGES = 15, 64


def slice_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - SLICE_BITS).cast("int")


def ranges_of(bitmap: bytes | None) -> list[tuple[int, int]]:
    """Closed ranges of ``h`` that hold the slices of a bitmap, RANGES at most: the widest gaps stay out."""
    bits = int.from_bytes(bytes(bitmap or b""), "little")
    half, width = 1 << (SLICE_BITS - 1), 1 << (64 - SLICE_BITS)
    used = sorted(s - 2 * half if s >= half else s for s in range(2 * half) if bits >> s & 1)
    if not used:
        return []
    gaps = sorted(((b - a, k) for k, (a, b) in enumerate(zip(used, used[1:])) if b - a > 1), reverse=True)[: RANGES - 1]
    cuts = sorted(k + 1 for _, k in gaps)
    return [(used[a] * width, (used[b - 1] + 1) * width - 1) for a, b in zip([0, *cuts], [*cuts, len(used)])]


def slices_used(h: Column) -> Column:
    """The slices of all values as a bitmap, an aggregate to observe."""
    return F.bitmap_construct_agg(F.bitmap_bit_position(slice_of(h) + 1))


def within(df: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """The rows of a sorted table in the ranges; the whole table where they cover most of it."""
    if sum(hi - lo + 1 for lo, hi in ranges) > 1 << 63:
        return df
    return df.where(" or ".join(f"h between {lo} and {hi}" for lo, hi in ranges) or "false")


def sorted_run(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a file for each FILE_ROWS of about ``rows`` rows, each a stretch of ``h`` in order."""
    files = max(1, -(-rows // FILE_ROWS))
    return df.repartitionById(files, (slice_of(F.col("h")) * files / (1 << SLICE_BITS)).cast("int")).sortWithinPartitions("h")
