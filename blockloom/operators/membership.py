"""A Bloom filter held as a table of 64-bit words, and joins that stay balanced when one key holds a third of the rows.

A key owns one word and sets ``BITS`` bits in it (a register-blocked filter). Building is ``bit_or`` per word, so it combines on
the map side and a hot key costs one row per task; probing is an equi-join on the word followed by an AND. Everything stays in
generated JVM code, and the filter can be written, merged and partitioned like any other table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 4
KEYS_PER_WORD = 4  # 16 bits a key: about one false positive in a hundred
#: Largest filter that is broadcast: 2 Mi words are 16 MiB of bits and at most about 100 MiB as a hash relation.
MAX_BROADCAST_WORDS = 1 << 21
#: A key is hot when it holds more than one in HOT_SHARE rows; there can't be more than HOT_SHARE such keys.
HOT_SHARE = 512


def words_for(n_keys: int) -> int:
    return max(64, -(-n_keys // KEYS_PER_WORD))


def word_of(key: Column, n_words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_words))


def mask_of(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(29))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int"))
    out = bit(0)
    for i in range(1, BITS):
        out = out.bitwiseOR(bit(i))
    return out


def build_filter(keys: DataFrame, key: str, n_words: int) -> DataFrame:
    """(word, bits) of all non-null values of ``key``; an empty input gives an empty filter, which answers no to everything."""
    rows = keys.where(F.col(key).isNotNull()).select(word_of(F.col(key), n_words).alias("word"), mask_of(F.col(key)).alias("mask"))
    return rows.groupBy("word").agg(F.bit_or("mask").alias("bits"))


def probe_filter(df: DataFrame, key: str, filt: DataFrame, n_words: int, flag: str = "maybe") -> DataFrame:
    """``df`` with ``flag``: false proves that the key is not in the filter. Null keys get false.

    A filter of at most MAX_BROADCAST_WORDS words is broadcast (its size is fixed by ``n_words``); a larger one stays
    partitioned by word and the probes are shuffled to it.
    """
    f = filt.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
    f = F.broadcast(f) if n_words <= MAX_BROADCAST_WORDS else f
    d = df.withColumn("__w", word_of(F.col(key), n_words)).withColumn("__m", mask_of(F.col(key)))
    hit = F.coalesce(F.col("__bits").bitwiseAND(F.col("__m")) == F.col("__m"), F.lit(False)) & F.col(key).isNotNull()
    return d.join(f, F.col("__w") == F.col("__word"), "left").withColumn(flag, hit).drop("__w", "__m", "__word", "__bits")


def skew_safe_join(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined to ``right`` (unique on ``key``) where one key may hold a large share of ``left``.

    Keys with more than one in HOT_SHARE of ``total`` rows, HOT_SHARE at most, have their rows of ``right`` broadcast, so their
    ``left`` rows stay where they are; all others take the shuffle join. ``how`` is inner, left, left_semi or left_anti.
    ``counts`` (key, n), if the rows of each key are already known, saves counting them.
    """
    counts = (left.groupBy(key).agg(F.count(F.lit(1))) if counts is None else counts).toDF("__hot", "__rows")
    hot = counts.where((F.col("__rows") > hot_floor(total)) & F.col("__hot").isNotNull()).select("__hot")
    hot_rows = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left_semi")
    cold_rows = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left_anti")
    hot_right = right.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left_semi")
    return hot_rows.join(F.broadcast(hot_right), key, how).unionByName(cold_rows.join(right, key, how))


def hot_floor(total: int) -> int:
    return max(1000, total // HOT_SHARE)
