"""Items into containers of fixed capacity by the sum-of-squares rule.

A container is at a fill level; the rule puts each item where the sum over levels of (number of open containers at the level)
squared becomes least. Levels are ``LEVELS`` equal steps of the capacity; a container keeps its exact fill, so nothing overflows
and nothing is lost to rounding. Only items larger than the capacity are split: into full containers and one rest, which is packed
like any item.

Items are packed in lanes of about ``lane_items``, drawn by a hash of the item: no key or size decides the lane, lanes are equal and
each fits one task. A lane leaves a few containers partly filled at its end, so the loss shrinks as 1 / lane_items.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 1024


class SumOfSquares:
    """Online packing of one lane. ``open[h]`` holds the exact fills, in order, of the open containers at level h.

    A fill is rounded up to its level, so a container less than one step from full is at the top level. Top-level containers count
    as full: they weigh nothing in the sum, but still take an item that fits exactly.
    """

    def __init__(self, capacity: int, levels: int = LEVELS):
        self.cap, self.levels = capacity, min(levels, capacity)
        self.count = np.zeros(self.levels + 1, np.int64)  # the level array; the top entry stays 0
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(self.levels + 1)]
        self.least = np.full(self.levels + 1, capacity + 1, np.int64)  # smallest exact fill at each level
        self.made = 0

    def level(self, fill: int) -> int:
        return -(-fill * self.levels // self.cap)

    def place(self, size: int) -> int:
        """The container of an item of 1..capacity."""
        if size >= self.cap:
            self.made += 1
            return self.made - 1
        free = self.cap - size
        h = np.flatnonzero(self.least <= free)
        fresh = 2 * self.count[self.level(size)] + 1  # change of the sum if a new container is opened
        best = None
        if len(h):
            target = -(-(self.least[h] + size) * self.levels // self.cap)
            change = 2 * (self.count[target] - self.count[h] + 1) - (target == self.levels)
            change[target == h] = 0
            best = change.min()
        if best is not None and best <= fresh:
            ties = h[change == best]
            lvl = int(ties[np.argmax(self.least[ties])])  # among equals the fullest
            i = bisect_left(self.open[lvl], (free + 1, -1)) - 1  # the fullest container there that still takes it
            fill, box = self.open[lvl].pop(i)
            self.count[lvl] -= lvl < self.levels
            self.least[lvl] = self.open[lvl][0][0] if self.open[lvl] else self.cap + 1
        else:
            fill, box = 0, self.made
            self.made += 1
        fill += size
        if fill < self.cap:
            lvl = self.level(fill)
            insort(self.open[lvl], (fill, box))
            self.count[lvl] += lvl < self.levels
            self.least[lvl] = self.open[lvl][0][0]
        return box


def pack(items: DataFrame, ids: list[str], size: str, capacity: int, lane_items: int = 100_000, levels: int = LEVELS) -> DataFrame:
    """(ids..., size, piece, pieces, piece_offset, piece_bytes, container) of every item: its container, or those of its pieces.

    Repeated rows (equal ids and size) are one item; rows with a null size or one below 1 are left out; null ids are allowed. Extra columns are ignored.
    An empty input gives no row. Items are taken in the order of a hash of their ids, which makes the result repeatable.
    """
    d = items.where(f"`{size}` >= 1").select(*[F.col(c) for c in ids], F.col(size).cast("bigint").alias("size")).distinct()
    n = items.count()
    lanes = max(1, -(-n // lane_items))
    d = d.withColumn("__o", F.xxhash64(*ids, "size")).withColumn("__lane", F.pmod(F.xxhash64("__o"), F.lit(lanes)).cast("int"))
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[: len(ids)]])
    schema = f"{out}, size bigint, piece int, pieces int, piece_offset bigint, piece_bytes bigint, container string"

    def lane(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__o", "size"], kind="stable").reset_index(drop=True)
        name, ss = int(pdf["__lane"].iloc[0]), SumOfSquares(capacity, levels)
        sizes = pdf["size"].to_numpy()
        full, rest = sizes // capacity, sizes % capacity
        pieces = full + (rest > 0)
        row = np.repeat(np.arange(len(pdf)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size_of = np.where(piece < full[row], capacity, rest[row])
        box = [ss.place(int(s)) for s in size_of]
        got = pdf.iloc[row][[*ids, "size"]].reset_index(drop=True)
        return got.assign(
            piece=piece.astype("int32"), pieces=pieces[row].astype("int32"), piece_offset=piece * capacity, piece_bytes=size_of, container=[f"{name}-{b}" for b in box]
        )

    return d.groupBy("__lane").applyInPandas(lane, schema)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, pieces, used_bytes, unused_share, at_least): ``at_least`` is the bytes divided by the capacity, rounded up."""
    per = packed.groupBy("container").agg(F.sum("piece_bytes").alias("b"), F.count(F.lit(1)).alias("p"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("p"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("b"), F.lit(0)).alias("used_bytes"), F.max("b").alias("fullest")).select(
        "containers", "pieces", "used_bytes", "fullest", (1 - F.try_divide("used_bytes", F.col("containers") * capacity)).alias("unused_share"), F.ceil(F.col("used_bytes") / capacity).alias("at_least")
    )
