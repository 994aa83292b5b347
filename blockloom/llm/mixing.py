"""Sources mixed to target shares of all tokens, by Pareto order sampling.

Each text has an expected number of copies. Its whole part is taken for certain. What is then missing of a source's tokens is drawn
by ranking the texts by random odds over inclusion odds and taking the smallest ranks until the tokens are reached: a sample of fixed
size with unequal probabilities. The rank order is never made as a whole: a histogram of the ranks finds the bin in which the size is
reached, a second one inside it the bin of the bin, and only that is sorted: about one in BINS ** 2 of a source's texts. A source of which
whole copies make up the size (the one that binds the total always is such) has nothing to rank.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.workspace import written

TOKENIZER = os.environ.get("BLOCKLOOM_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")
BINS = 4096
SEED = 41


class _Lengths(dict):
    """Tokens of a piece between blanks, counted once per task and spelling."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.limit = 1 << 18  # some tens of MB a worker; a full memory starts afresh

    def __missing__(self, piece: str) -> int:
        if len(self) > self.limit:
            self.clear()
        n = len(self.sp.encode(piece, num_threads=1))
        self[piece] = n
        return n


def count_tokens(text: str, lengths: _Lengths) -> int:
    """Tokens of the whole text. No token of the vocabulary has a blank after another character, so blanks separate the counts."""
    if "  " not in text and not text.startswith(" ") and not text.endswith(" ") and "▁" not in text:
        return sum(map(lengths.__getitem__, text.split(" ")))
    return len(lengths.sp.encode(text, num_threads=1))


def token_counts(documents: DataFrame, model_file: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, text_key, tokens) of every document with a source and some text. The tokenizer's file (about 1 MB) is read by the
    driver and broadcast, executors need no copy of their own."""
    with open(model_file, "rb") as f:
        model = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _Lengths(model.value)
        for b in batches:
            n = pa.array([count_tokens(t, lengths) for t in b.column(3).to_pylist()], pa.int64())
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), n], ["doc_id", "source", "text_key", "tokens"])

    d = documents.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), F.sha2("text", 256).alias("text_key"), "text")
    return d.where("source is not null").mapInArrow(count, "doc_id bigint, source string, text_key string, tokens bigint")


def source_name(c):
    """Letter case and ``-``, ``_`` or blank don't distinguish sources; nothing but those is null."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[-_\s]+", ""), F.lit(""))


def allocate(units: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, name, target_share, max_repeats, texts, tokens, share, goal): one row per target.

    ``share`` is the target share among the sources that have texts. ``goal`` is the tokens to draw: share x the total, where the
    total is ``total_tokens`` or the largest at which no source needs more than max_repeats copies of a text, whichever is less.
    """
    t = targets.where("source is not null and target_share > 0").select(source_name(F.col("source")).alias("source"), F.col("source").alias("name"), "target_share", F.greatest(F.col("max_repeats"), F.lit(0)).alias("max_repeats"))
    t = t.groupBy("source").agg(F.min("name").alias("name"), F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = units.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens"))
    t = t.join(have, "source", "left").fillna(0, ["texts", "tokens"])
    usable = (F.col("tokens") > 0) & (F.col("max_repeats") > 0)
    all_rows = Window.partitionBy(F.lit(1))  # one row per target source
    t = t.withColumn("share", F.when(usable, F.col("target_share")).otherwise(0.0))
    t = t.withColumn("share", F.coalesce(F.try_divide("share", F.sum("share").over(all_rows)), F.lit(0.0)))
    most = F.min(F.when(F.col("share") > 0, F.col("tokens") * F.col("max_repeats") / F.col("share"))).over(all_rows)
    total = F.coalesce(most, F.lit(0.0)) if total_tokens is None else F.least(F.coalesce(most, F.lit(0.0)), F.lit(float(total_tokens)))
    return t.withColumn("goal", F.col("share") * total)


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, damping: float = 0.5, model_file: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(drawn, report). ``drawn``: (doc_id, source, tokens, copies) of each text drawn, by its smallest doc_id.

    Equal texts are one text, of the source of its smallest doc_id, and are drawn at most max_repeats times. Documents without a
    source or text, or of a source without a target, aren't drawn. Inclusion is proportional to tokens ** -damping: a very long text
    doesn't take the place of many short ones (0: equal probabilities). A source without texts is reported with 0.
    """
    counted = token_counts(documents, model_file)
    units = counted.groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("u")).select("u.*").where("tokens > 0")
    units = written(units, "units")
    plan = written(allocate(units, targets, total_tokens), "plan")
    u = units.join(F.broadcast(plan.where("goal > 0").select("source", "goal", F.col("tokens").alias("held"))), "source")
    # what is within a millionth of whole copies is whole copies: a quotient just off is rounding
    copies = F.col("goal") / F.col("held")
    u = u.withColumn("whole", F.floor(copies + 1e-6).cast("bigint"))
    u = u.withColumn("left", F.when(copies - F.col("whole") < 1e-6, 0.0).otherwise(F.col("goal") - F.col("whole") * F.col("held"))).withColumn("w", F.pow(F.col("tokens").cast("double"), F.lit(-damping)))
    # the factor c of each source with sum(min(1, c w) tokens) = left, by bisection on a histogram of the weights
    u = written(u.withColumn("wb", F.floor(F.log2("w") * 64).cast("int")), "weighted")
    part = u.where("left > 0")
    hist = part.groupBy("source", "wb").agg(F.sum("tokens").alias("t"), F.sum(F.col("w") * F.col("tokens")).alias("wt"), F.max("w").alias("top"), F.max("left").alias("left"))
    by = Window.partitionBy("source").orderBy(F.desc("wb"))
    # with the bins above one certain (pi = 1), c must fill the rest from the others
    hist = hist.withColumn("sure", F.coalesce(F.sum("t").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hist = hist.withColumn("rest", F.sum("wt").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    hist = hist.withColumn("c", (F.col("left") - F.col("sure")) / F.col("rest"))
    fit = hist.where(F.col("c") * F.col("top") <= 1.0).groupBy("source").agg(F.max_by("c", "wb").alias("c"))
    part = part.join(F.broadcast(fit), "source", "left")  # one row per target source
    pi = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("c") * F.col("w"), F.lit(1.0))))
    odd = (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    part = part.withColumn("pi", pi).withColumn("odds", F.when(F.col("pi") >= 1.0, 0.0).when(F.col("pi") <= 0.0, F.lit(1e300)).otherwise((odd / (1 - odd)) * (1 - F.col("pi")) / F.col("pi")))
    fine = F.least(F.floor(F.col("odds") / (1 + F.col("odds")) * BINS * BINS), F.lit(BINS * BINS - 1)).cast("bigint")
    part = part.withColumn("bin", F.floor(fine / BINS).cast("int")).withColumn("bin2", (fine % BINS).cast("int")).select("doc_id", "source", "tokens", "whole", "left", "odds", "bin", "bin2")
    part = written(part, "ranked")
    cut = _reached(part.withColumn("before", F.lit(0.0)), "bin", "cut")
    part = part.join(F.broadcast(cut), "source", "left")  # one row per target source, as are the next ones
    cut2 = _reached(part.where("bin = cut"), "bin2", "cut2")
    part = part.drop("before").join(F.broadcast(cut2), "source", "left")
    below = part.where("cut is null or bin < cut or (bin = cut and (cut2 is null or bin2 < cut2))").select("doc_id", "source", "tokens", "whole", F.lit(1).alias("extra"))
    above = part.where("bin > cut or (bin = cut and bin2 > cut2)").select("doc_id", "source", "tokens", "whole", F.lit(0).alias("extra"))
    order = Window.partitionBy("source").orderBy("odds", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = part.where("bin = cut and bin2 = cut2").withColumn("upto", F.col("before") + F.sum("tokens").over(order))
    # the text in which the size is reached is taken if that comes nearer to it
    at = at.select("doc_id", "source", "tokens", "whole", (F.col("upto") - F.col("tokens") / 2 <= F.col("left")).cast("int").alias("extra"))
    sure = u.where("left <= 0").select("doc_id", "source", "tokens", "whole", F.lit(0).alias("extra"))
    every = below.unionByName(above).unionByName(at).unionByName(sure)
    drawn = every.select("doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).cast("int").alias("copies"))
    limits = plan.select("source", "name", "max_repeats")
    drawn = drawn.join(F.broadcast(limits), "source").select("doc_id", F.col("name").alias("source"), "tokens", F.least("copies", "max_repeats").alias("copies")).where("copies > 0")
    return drawn, _report(drawn, plan)


def _reached(rows: DataFrame, bin: str, name: str) -> DataFrame:
    """(source, ``name``, before): the bin in which a source's tokens exceed what is left, and the tokens before that bin."""
    bins = rows.groupBy("source", bin).agg(F.sum("tokens").alias("t"), F.max("left").alias("left"), F.max("before").alias("at"))
    up = Window.partitionBy("source").orderBy(bin).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = bins.withColumn("upto", F.col("at") + F.sum("t").over(up)).where("upto > left")
    return over.groupBy("source").agg(F.min(F.struct(F.col(bin), (F.col("upto") - F.col("t")).alias("before"))).alias("m")).select("source", F.col(f"m.{bin}").alias(name), "m.before")


def _report(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    got = drawn.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("texts_drawn"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens_drawn"))
    r = plan.join(got, "name", "left").fillna(0, ["texts_drawn", "copies", "tokens_drawn"])
    actual = F.coalesce(F.try_divide("tokens_drawn", F.sum("tokens_drawn").over(Window.partitionBy(F.lit(1)))), F.lit(0.0))
    return r.select(F.col("name").alias("source"), "target_share", F.col("share").alias("attainable_share"), "max_repeats", "texts", "tokens", "texts_drawn", "copies", "tokens_drawn", actual.alias("actual_share"))
