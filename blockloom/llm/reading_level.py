"""Reading level of each document from the rank of its words and the complexity of its sentences.

Coverage rank: the size of the smallest frequency-ranked vocabulary that covers a fixed share of a document's words. Sentence
complexity: the median words of a sentence and the median over sentences of the mean word length. Medians and a share of one half
make the level that of the text as a whole: a few hard sentences or an inserted passage don't move them.

Only running text counts: fenced or indented code, tables, commands, records and log lines are left out, list marks, quote marks and
line numbers are taken off. A sentence that a hard wrap cut into lines is put together again: a line goes on with the next one where it has
no final punctuation, that one begins in lower case and its first word wouldn't have fitted into the width of the paragraph. English is told by function words, whatever ``lang`` says. Steps: one pass writes the sentences and counts
the words of all English documents; the vocabulary is ranked; one pass over the written sentences gives the measures; grades are
calibrated per cell of the three measures in SQL and looked up in SQL.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.operators.membership import skew_safe_join
from blockloom.workspace import fresh_path, written

COVER = 0.5
#: Words of the vocabulary that is sent to the tasks, at most. Documents of which the coverage rank lies beyond are ranked by joins.
VOCABULARY = 65_536
#: Labelled documents used for calibration, drawn by a hash of their id.
MAX_LABELS = 20_000
MIN_WORDS = 8
#: Document ids that are broadcast at most (some 20 MB).
MAX_IDS = 500_000
#: steps of a cell per unit of ln(1 + coverage rank), ln(sentence words), letters of a word
STEPS = (4.0, 3.0, 2.0)

# fixed values: function words that tell English from its neighbours here
ENGLISH = frozenset("the of and to a is in it that for on with as by at from this are be was not or an but if its when which has have you".split())
OTHERS = frozenset(
    "der die das und ist nicht ein eine den dem von zu mit auf für el la los las de que y en un una por con para le les des et est une du dans pour sur se del al".split()
)

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_TAG = re.compile(r"<[^<>\n]*>")
_SKIP = ("|", "    ", "\t", "$ ", "{", "}")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|;\s")
_END = re.compile(r"[.!?…:;][\"'”’)\]]*$")
#: widths at which texts are wrapped; shorter lines are lists, longer ones aren't wrapped
_WRAP = range(40, 121)
_EDGE = ".,;:!?\"“”‘’()[]<>*_…`'«»„¿¡"


def _unwrapped(lines: list[str]) -> list[str]:
    """The lines, those that a hard wrap cut put together again; quote marks of the later ones are taken off."""
    out: list[str] = []
    end, width = 0, 0  # the paragraph's
    before = ""
    for k, line in enumerate(lines):
        bare = line.lstrip("> ")
        if before and bare[:1].islower() and not line.startswith(_SKIP) and not before.startswith(_SKIP) and not _END.search(before):
            if k >= end:
                end = k
                while end < len(lines) and lines[end].strip("> \r"):
                    end += 1
                first = k - 1
                while first and lines[first - 1].strip("> \r"):
                    first -= 1
                width = max(len(x.rstrip()) for x in lines[first:end])
            head = bare.split(None, 1)[0]
            if width in _WRAP and len(before) + 1 + len(head) > width and head.strip(_EDGE).isalpha():
                out[-1] = f"{out[-1].rstrip()} {bare}"
                before = line.rstrip()
                continue
        out.append(line)
        before = line.rstrip()
    return out


def sentences(text: str) -> list[list[str]]:
    """The sentences of a text's running parts as lower-case words."""
    t = text
    if "```" in t or "~~~" in t:
        t = _FENCE.sub("\n", t)
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "&" in t:
        t = html.unescape(t)
    out: list[list[str]] = []
    for line in _unwrapped(t.split("\n")):
        if not line or line.startswith(_SKIP):
            continue
        kept, n, odd = [], 0, 0
        for s in _SPLIT.split(line):
            w = []
            for p in s.split():
                q = p.strip(_EDGE)
                if q.isalpha():
                    w.append(q)
                elif q:
                    if q.replace("-", "").replace("’", "").replace("'", "").isalpha():
                        w.append(q)
                    else:
                        odd += 1
            n += len(w)
            if len(w) >= 3:
                kept.append(w)
        if n >= 4 and n >= 2 * odd:
            out += kept
    return [[x.lower() for x in w] for w in out]


def _is_english(ss: list[list[str]]) -> bool:
    score = 0
    for s in ss:
        for w in s:
            score += (w in ENGLISH) - (w in OTHERS)
    return score > 0


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind d (a document's sentences, one a line) and of kind w (a word and its count in this task)."""
    words: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys, n = list(words), list(words.values())
        words.clear()
        return pa.record_batch([pa.array(["w"] * len(keys), pa.string()), pa.nulls(len(keys), pa.int64()), pa.array(keys, pa.string()), pa.array(n, pa.int64())], ["kind", "doc_id", "text", "n"])

    for b in batches:
        ids, texts, ns = [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ss = sentences(t)
            n = sum(map(len, ss))
            if n >= MIN_WORDS and _is_english(ss):
                for s in ss:
                    words.update(s)
                ids.append(i)
                texts.append("\n".join(map(" ".join, ss)))
                ns.append(n)
        yield pa.record_batch([pa.array(["d"] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(ns, pa.int64())], ["kind", "doc_id", "text", "n"])
        if len(words) > 1 << 18:
            yield flush()
    yield flush()


def _measure(rank: dict[str, int], unknown: int, cover: float):
    """The measures of written sentences; the rank is null where it lies beyond the words of ``rank``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = rank.get
        for b in batches:
            cov, sent, word = [], [], []
            for t in b.column(1).to_pylist():
                ss = [s.split(" ") for s in t.split("\n")]
                flat = [w for s in ss for w in s]
                r = np.fromiter([get(w, unknown) for w in flat], np.int64, len(flat))
                k = int(np.ceil(cover * len(r))) - 1
                at = int(np.partition(r, k)[k])
                cov.append(at if at < unknown else None)
                n = np.array([len(s) for s in ss])
                letters = np.add.reduceat(np.fromiter(map(len, flat), np.int64, len(flat)), np.concatenate([[0], np.cumsum(n)[:-1]]))
                sent.append(float(np.median(n)))
                word.append(float(np.median(letters / n)))
            yield pa.record_batch([b.column(0), pa.array(cov, pa.int64()), pa.array(sent, pa.float64()), pa.array(word, pa.float64())], ["doc_id", "coverage_rank", "sentence_words", "word_letters"])

    return run


def measures(documents: DataFrame, cover: float = COVER, vocabulary: int = VOCABULARY) -> DataFrame:
    """(doc_id, coverage_rank, sentence_words, word_letters) of each document with English running text.

    Null, empty and non-English texts, and those with fewer than MIN_WORDS words of running text, have no row. Extra columns are
    ignored; an empty table gives no row.
    """
    spark = documents.sparkSession
    path = fresh_path(spark, "prose")
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    docs.mapInArrow(_read, "kind string, doc_id bigint, text string, n bigint").write.partitionBy("kind").option("compression", "zstd").parquet(path)
    got = spark.read.schema("doc_id bigint, text string, n bigint, kind string").parquet(path)
    counts = got.where("kind = 'w'").groupBy("text").agg(F.sum("n").alias("n"))
    counts = written(counts.where("text is not null"), "word-counts")
    floor = _least_count(counts, vocabulary)
    top = counts.where(F.col("n") > floor).collect()  # at most ``vocabulary`` words, and none are sent that aren't among them
    rank = {r["text"]: k + 1 for k, r in enumerate(sorted(top, key=lambda r: (-r["n"], r["text"])))}
    prose = got.where("kind = 'd'").select("doc_id", "text")
    measured = prose.mapInArrow(_measure(rank, len(rank) + 1, cover), "doc_id bigint, coverage_rank bigint, sentence_words double, word_letters double")
    measured = written(measured, "measured")
    beyond = measured.where("coverage_rank is null").drop("coverage_rank")
    n = beyond.count()
    if not n:
        return measured
    ids = beyond.select("doc_id")  # mostly a few; their sentences stay where they lie while the ids are few enough to be broadcast
    ranks = _ranks_beyond(prose.join(F.broadcast(ids) if n <= MAX_IDS else ids, "doc_id", "left_semi"), counts, floor, len(rank), cover)
    return measured.where("coverage_rank is not null").unionByName(beyond.join(ranks, "doc_id").select(measured.columns))


def _least_count(counts: DataFrame, vocabulary: int) -> int:
    """The least count c for which at most ``vocabulary`` words come more than c times. Counts are looked for in 64 steps per doubling
    first, so a few thousand rows of a histogram are all that is gathered; then within the step that holds the limit."""
    step = F.floor(F.log2("n") * 64).cast("int")
    hist = sorted(((r["s"], r["k"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    words = 0
    for s, k in hist:
        if words + k > vocabulary:
            inside = counts.where(step == s).groupBy("n").agg(F.count(F.lit(1)).alias("k"))
            run = Window.partitionBy(F.lit(1)).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            # the counts of one step: a window over a 64th of a doubling
            over = inside.withColumn("upto", F.sum("k").over(run) + F.lit(words)).where(F.col("upto") > vocabulary)
            return int(over.agg(F.max("n")).first()[0])
        words += k
    return 0


def _ranks_beyond(prose: DataFrame, counts: DataFrame, floor: int, known: int, cover: float) -> DataFrame:
    """(doc_id, coverage_rank) of documents whose rank lies beyond the vocabulary that was sent: the words that come at least as often as
    the one with which the share is covered. Words of one count share the rank of the last of them."""
    spans = counts.where(F.col("n") <= floor).groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    run = Window.partitionBy(F.lit(1)).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.select("n", (F.sum("k").over(run) + F.lit(known)).alias("rank"))  # one row a count up to the floor
    words = prose.select("doc_id", F.explode(F.split("text", "[ \n]")).alias("text")).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("c"))
    # a word above the floor has a lower rank than any beyond it, whichever
    rare = counts.where(F.col("n") <= floor).join(spans, "n").select("text", "rank")
    of = skew_safe_join(words, rare, "text", max(1, known), "left").groupBy("doc_id", F.coalesce("rank", F.lit(0)).alias("rank")).agg(F.sum("c").alias("c"))
    w = Window.partitionBy("doc_id")
    upto = F.sum("c").over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    of = of.withColumn("need", F.ceil(F.sum("c").over(w) * F.lit(cover))).withColumn("upto", upto)
    return of.where("upto >= need").groupBy("doc_id").agg(F.min("rank").cast("bigint").alias("coverage_rank"))


_CELL = ["floor(ln(1 + coverage_rank) * {0} / {k})", "floor(ln(sentence_words) * {1} / {k})", "floor(word_letters * {2} / {k})"]


def _with_cells(df: DataFrame, k: int) -> DataFrame:
    return df.withColumns({f"c{k}_{i}": F.expr(f"cast({e.format(*STEPS, k=k)} as int)") for i, e in enumerate(_CELL)})


def calibrate(measured: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> tuple[DataFrame, DataFrame, float]:
    """(fine, coarse, overall): the mean grade of each cell of the measures, in SQL.

    A document's grade is the mean of its grades; null grades are left out. Every labelled document counts fully in its own cell and
    half as much per step in the 26 cells around it. Coarse cells are four times as wide. At most ``max_labels`` documents take part.
    """
    grades = labels.where("grade is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("grade").alias("grade"))
    grades = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    known = written(_with_cells(measured.join(F.broadcast(grades), "doc_id"), 1), "graded")
    near = known
    for i in range(3):
        near = near.withColumn(f"d{i}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    weight = F.pow(F.lit(0.5), 1.0 * sum((F.abs(f"d{i}") for i in range(3)), F.lit(0)))
    near = near.select(*[(F.col(f"c1_{i}") + F.col(f"d{i}")).alias(f"c1_{i}") for i in range(3)], "grade", F.when(sum((F.abs(f"d{i}") for i in range(3)), F.lit(0)) == 0, 4.0).otherwise(weight).alias("w"))
    fine = near.groupBy("c1_0", "c1_1", "c1_2").agg((F.sum(F.col("grade") * F.col("w")) / F.sum("w")).alias("fine"))
    coarse = _with_cells(known, 4).groupBy("c4_0", "c4_1", "c4_2").agg(F.avg("grade").alias("coarse"))
    overall = known.agg(F.avg("grade")).first()[0]
    return fine, coarse, float(overall) if overall is not None else 3.0


def levels(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, coverage_rank, sentence_words, word_letters, score, level): the calibrated grade and the level 1 to 5 it rounds to.

    The calibration tables have at most 27 rows per labelled document of the bounded sample, so they are broadcast.
    Without any label every document gets the middle of the scale.
    """
    m = written(measures(documents), "measures")
    fine, coarse, overall = calibrate(m, labels, max_labels)
    d = _with_cells(_with_cells(m, 1), 4)
    d = d.join(F.broadcast(fine), [f"c1_{i}" for i in range(3)], "left").join(F.broadcast(coarse), [f"c4_{i}" for i in range(3)], "left")
    d = d.withColumn("score", F.coalesce("fine", "coarse", F.lit(overall)))
    level = F.least(F.lit(5), F.greatest(F.lit(1), F.floor(F.col("score") + 0.5).cast("int")))
    return d.select("doc_id", "coverage_rank", "sentence_words", "word_letters", "score", level.alias("level"))


def profile(levelled: DataFrame) -> DataFrame:
    """(level, documents, share, mean_score)"""
    g = levelled.groupBy("level").agg(F.count(F.lit(1)).alias("documents"), F.avg("score").alias("mean_score"))
    return g.withColumn("share", F.col("documents") / F.sum("documents").over(Window.partitionBy(F.lit(1))))
