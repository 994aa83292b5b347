"""Per-key totals by dense accumulator arrays on equal input splits.

Spark cuts the input into splits of equal size whatever the keys, so a key with a third of the rows is spread over all tasks. Each
task dictionary-encodes the keys it meets, adds into dense numpy arrays by code and hands on one block of sums; the blocks are
then summed by key in a distributed aggregation. No row is shuffled by its key before it is summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A task hands its block on when it has met so many keys; bounds its memory, changes no result.
MAX_LOCAL_KEYS = 1 << 20
_NONE = np.iinfo(np.int64).min


class _Block:
    def __init__(self) -> None:
        self.codes: dict[object, int] = {}
        self.rows, self.lo, self.hi = (np.zeros(64, np.int64) for _ in range(3))
        self.last = np.full(64, _NONE)

    def add(self, keys: pa.Array, size: np.ndarray, at: np.ndarray) -> None:
        enc = keys.dictionary_encode(null_encoding="encode")
        local = np.fromiter((self.codes.setdefault(k, len(self.codes)) for k in enc.dictionary.to_pylist()), np.int64, len(enc.dictionary))
        if len(self.codes) > len(self.rows):
            for name, fill in (("rows", 0), ("lo", 0), ("hi", 0), ("last", _NONE)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.full(2 * len(self.codes) - len(old), fill, np.int64)]))
        code, k = enc.indices.to_numpy(zero_copy_only=False), len(local)
        # bincount adds in floats: 26-bit halves keep the sums of a batch exact
        self.rows[local] += np.bincount(code, minlength=k)
        self.lo[local] += np.bincount(code, weights=size & 0x3FFFFFF, minlength=k).astype(np.int64)
        self.hi[local] += np.bincount(code, weights=size >> 26, minlength=k).astype(np.int64)
        top = np.full(k, _NONE)
        np.maximum.at(top, code, at)
        self.last[local] = np.maximum(self.last[local], top)

    def batch(self, key_type: pa.DataType) -> pa.RecordBatch:
        n = len(self.codes)
        last = pa.array(self.last[:n], mask=self.last[:n] == _NONE)
        total = (self.hi[:n].astype(object) << 26) + self.lo[:n]  # Python integers: decimal(38,0) can't overflow here
        return pa.record_batch(
            [pa.array(list(self.codes), key_type), pa.array(self.rows[:n]), pa.array([str(x) for x in total]), last],
            ["key", "n_rows", "n_bytes", "last_us"],
        )


def dense_totals(df: DataFrame, key: str, size: Column, at: Column, canonical=None) -> DataFrame:
    """(key, n_rows, n_bytes, last_at) for every value of ``key``, the null key included.

    ``size`` is summed (null counts 0) and ``at`` is maximised (null never wins). Keys are grouped as written by the accumulators
    and brought to their canonical form (``canonical``, a column function) afterwards, on one row per key and task instead of on
    every row. An empty input gives no row.
    """
    src = df.select(
        F.col(key).cast("string").alias("key"),
        F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint")).alias("size"),
        F.coalesce(F.unix_micros(at.cast("timestamp")), F.lit(int(_NONE))).alias("at"),
    )

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for b in batches:
            if b.num_rows:
                block.add(b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy())
            if len(block.codes) > MAX_LOCAL_KEYS:
                yield block.batch(pa.string())
                block = _Block()
        if block.codes:
            yield block.batch(pa.string())

    blocks = src.mapInArrow(accumulate, "key string, n_rows bigint, n_bytes string, last_us bigint")
    k = canonical(F.col("key")) if canonical else F.col("key")
    return (
        blocks.groupBy(k.alias("key"))
        .agg(F.sum("n_rows").alias("n_rows"), F.sum(F.col("n_bytes").cast("decimal(38,0)")).alias("n_bytes"), F.max("last_us").alias("last_us"))
        .select("key", "n_rows", F.col("n_bytes").cast("bigint").alias("n_bytes"), F.timestamp_micros("last_us").alias("last_at"))
    )
