"""Has this key been seen before? Filter, then verify, and count how often the filter was wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.runs import ranges_of, slices_used, sorted_run, within
from blockloom.operators.membership import mask_of, skew_safe_join, word_of, words_for
from blockloom.workspace import fresh_path, written


class SeenKeys:
    """All keys accepted so far: full keys on disk, sorted by hash, and their Bloom filter as a word table beside them."""

    def __init__(self, spark: SparkSession, known: DataFrame, path: str | None = None, n_words: int | None = None):
        """``known``: one column ``key``; nulls and repeats are ignored, an empty history is fine. ``n_words`` bounds the filter."""
        self.spark, self.path = spark, path or fresh_path(spark, "seen")
        known = written(known.where("key is not null").select("key").distinct(), "known")
        self.stored = known.count()
        #: the ranges of the stored keys that the last check's lookups read
        self.asked: list[list[tuple[int, int]]] = []
        self.n_words = n_words or words_for(self.stored)
        self._append(known, self.stored)

    def _append(self, new: DataFrame, rows: int) -> None:
        """Appends keys that aren't there yet: a run sorted by hash, and their filter words."""
        sorted_run(new.select(F.xxhash64("key").alias("h"), "key"), rows).write.mode("append").parquet(f"{self.path}/keys")
        filt = new.select(word_of(F.col("key"), self.n_words).alias("word"), mask_of(F.col("key")).alias("mask"))
        filt.groupBy("word").agg(F.bit_or("mask").alias("bits")).write.mode("append").parquet(f"{self.path}/filter")
        self.keys = self.spark.read.schema("h bigint, key string").parquet(f"{self.path}/keys")
        self.filter = self.spark.read.schema("word bigint, bits bigint").parquet(f"{self.path}/filter").groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def add(self, keys: DataFrame) -> None:
        """Takes the keys of a checked batch into the history: both tables are appended, nothing is rewritten. The filter's number of
        words stays, so choose ``n_words`` for the keys to come; a fuller filter only sends more keys to the exact lookup."""
        new = keys.where("key is not null").select("key").distinct().join(self.keys.select("key"), "key", "left_anti")
        new = written(new, "new-keys")
        rows = new.count()
        self.stored += rows
        self._append(new, rows)

    def _looked_up(self, keys: DataFrame, name: str) -> DataFrame:
        """``keys`` (key, ...) with ``known``: only the ranges of the stored keys in which some of them lie are read."""
        seen = Observation()
        h = F.xxhash64("key")
        keys.withColumn("h", h).observe(seen, slices_used(F.col("h")).alias("slices")).write.parquet(path := fresh_path(self.spark, name))
        ranges = ranges_of(seen.get["slices"])
        self.asked.append(ranges)
        found = self.spark.read.schema(keys.withColumn("h", h).schema).parquet(path)
        have = within(self.keys, ranges).select("h", "key", F.lit(True).alias("known"))
        return found.join(have, ["h", "key"], "left").drop("h").withColumn("known", F.coalesce("known", F.lit(False)))

    def check(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(seen, verdicts) of a batch with columns ``record_id`` (order of arrival, unique) and ``key``.

        ``seen`` has the record_id of each record whose key is in the history or came with a smaller record_id. Records with a
        null key are never seen and hide nothing. ``verdicts`` has one row per cell, (maybe, truly, n_records): what the filter
        said against what the full keys show; a cell is a (word, mask) of the filter, which equal keys share.

        The batch is first reduced to its cells: a key with a third of all records is one row from the map side on. A cell that
        the filter rejects and that one record holds is answered at once. Only other cells send their full key to the keys on
        disk. Cells in which two different keys of the batch meet are resolved by their full keys.
        """
        self.asked = []
        rows = batch.where("key is not null").select("record_id", "key", word_of(F.col("key"), self.n_words).alias("word"), mask_of(F.col("key")).alias("mask"))
        rows = written(rows.withColumn("cell", F.struct("word", "mask")), "batch")
        cells = rows.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"), F.min("key").alias("key"), F.max("key").alias("other")
        ).select("*", "cell.*")
        bits = self.filter.select("word", "bits")
        hit = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
        cells = written(cells.join(bits, "word", "left").withColumn("maybe", hit).drop("bits"), "cells")
        single = cells.where("key = other")
        verified = self._looked_up(single.where("maybe"), "asked")
        single = written(verified.unionByName(single.where("not maybe").withColumn("known", F.lit(False))), "verified")
        alone = single.where("n = 1 and known").select(F.col("first").alias("record_id"))
        # equal keys inside the batch: every record but the first, or all of them when the history has the key
        total = rows.count()
        again = single.where("n > 1").select("cell", "first", "known", "n")
        repeats = skew_safe_join(rows.select("cell", "record_id"), again.drop("n"), "cell", total, counts=again.select("cell", "n")).where("known or record_id > first").select("record_id")
        # different keys in one cell: by full key
        mixed = rows.join(cells.where("key <> other").select("cell"), "cell", "left_semi")
        firsts = mixed.groupBy("key").agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("n"))
        firsts = written(self._looked_up(firsts, "mixed-asked"), "mixed")
        clash = skew_safe_join(mixed.select("key", "record_id"), firsts, "key", total).where("known or record_id > first").select("record_id")
        seen = alone.unionByName(repeats).unionByName(clash)
        truth = single.select("maybe", F.col("known").alias("truly"), F.col("n").alias("n_records"))
        probed = firsts.withColumn("word", word_of(F.col("key"), self.n_words)).withColumn("mask", mask_of(F.col("key")))
        in_mixed = probed.join(bits, "word", "left").select(hit.alias("maybe"), F.col("known").alias("truly"), F.col("n").alias("n_records"))
        return seen, truth.unionByName(in_mixed)


def error_report(verdicts: DataFrame) -> DataFrame:
    """(filter_said, truth, keys, records, share_of_keys): the disproved positives are the filter's measured error; a positive that
    the filter had rejected can't occur and would show as (no, known)."""
    g = verdicts.groupBy("maybe", "truly").agg(F.count(F.lit(1)).alias("keys"), F.sum("n_records").alias("records"))
    total = verdicts.agg(F.count(F.lit(1))).scalar()
    return g.select(
        F.when(F.col("maybe"), "maybe").otherwise("no").alias("filter_said"), F.when(F.col("truly"), "known").otherwise("new").alias("truth"), "keys", "records", (F.col("keys") / total).alias("share_of_keys")
    )
