"""Canonical forms, the Bloom filter, differences, orphans and totals: edge cases and brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from blockloom.functions import identity as I
from blockloom.operators import membership as M
from blockloom.operators.dense import dense_totals
from blockloom.operators.diff import current_rows, diff
from blockloom.operators.orphans import orphans, parent_summary, reference_summary

H64, H40 = "ab12" * 16, "cd34" * 10
T = [dt.datetime(2024, m, 1) for m in range(1, 13)]


@pytest.mark.parametrize(
    "text,want",
    [(H64, H64), (H64.upper(), H64), (f"  0x{H64}\n", H64), (f"sha-256:{H64}", H64), (f"SHA256:{H64}:4096 ", H64), (f"\t{H64}:77", H64), (None, None), ("", ""), (" Zz ", "zz")],
)
def test_digest(spark, text, want):
    d = spark.createDataFrame([(text,)], "x string").select(I.digest(F.col("x")).alias("x"))
    assert d.first()[0] == want


@pytest.mark.parametrize(
    "text,want",
    [
        (f"Sha256:{H64.upper()}:0042", f"sha-256:{H64}:42"),
        (f" sha-1:{H40}:5 ", f"sha-1:{H40}:5"),
        (f"BLAKE3 : 0x{H64} : 0", f"blake3:{H64}:0"),
        ("what:ever", "what:ever"),
        (None, None),
    ],
)
def test_block_key(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(I.block_key(F.col("x"))).first()[0] == want


def test_org_and_algorithm(spark):
    u = "52e33dc1-43d4-4629-ab73-3f7488045878"
    forms = [u, u.upper(), u.replace("-", ""), "{" + u + "}", "urn:uuid:" + u, f"  {u}\n", "(" + u.upper() + ")"]
    d = spark.createDataFrame([(f,) for f in forms], "x string").select(I.org(F.col("x")))
    assert {r[0] for r in d.collect()} == {u}
    d = spark.createDataFrame([("",), (None,), ("  ",)], "x string").select(I.org(F.col("x")))
    assert {r[0] for r in d.collect()} == {None}
    d = spark.createDataFrame([(" SHA-256",), ("sha256 ",), ("Sha-256",)], "x string").select(I.algorithm(F.col("x")))
    assert {r[0] for r in d.collect()} == {"sha-256"}


def test_valid_keys(spark):
    rows = [("sha-1", H40, 5, True), ("sha-1", H64, 5, False), ("sha-256", H64, 5, True), ("sha-256", None, 5, False), ("blake3", H64, None, False), (None, H64, 5, False), ("md5", H64, 5, False), ("sha-256", H64[:-1] + "g", 5, False)]
    d = spark.createDataFrame(rows, "a string, d string, s bigint, ok boolean")
    assert d.where(I.valid_block_key(F.col("a"), F.col("d"), F.col("s")).isNotNull() != F.col("ok")).count() == 0


def test_filter_never_misses(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    n = M.words_for(5000)
    f = M.build_filter(keys, "k", n)
    assert M.probe_filter(keys, "k", f, n).where("not maybe").count() == 0
    others = spark.range(5000, 25000).select(F.concat(F.lit("k"), "id").alias("k"))
    assert M.probe_filter(others, "k", f, n).where("maybe").count() < 600
    empty = M.build_filter(keys.limit(0), "k", n)
    assert M.probe_filter(keys, "k", empty, n).where("maybe").count() == 0
    nulls = spark.createDataFrame([(None,)], "k string")
    assert [r[0] for r in M.probe_filter(nulls, "k", f, n).select("maybe").collect()] == [False]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_safe_join(spark, rows, how):
    left = spark.range(6000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 700).cast("string").alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k string, id bigint"))
    right = spark.range(0, 600, 2).select(F.col("id").cast("string").alias("k"), (F.col("id") * 10).alias("v"))
    want = rows(left.join(right, "k", how))
    assert rows(M.skew_safe_join(left, right, "k", 6000, how)) == want
    counts = left.groupBy("k").count()
    assert rows(M.skew_safe_join(left, right, "k", 6000, how, counts)) == want
    clash = M.skew_safe_join(left.withColumnRenamed("k", "n"), right.withColumnRenamed("k", "n"), "n", 6000, how)
    assert rows(clash) == want


REP = "algo int, hash binary, etag string, size bigint, at timestamp, extra string"


def test_diff(spark, rows):
    a = [
        (1, b"same", '"AA"', 5, T[0], "x"),
        (1, b"old", "x", 1, T[0], None),
        (1, b"old", "y", 2, T[1], None),
        (1, b"null", None, None, None, None),
        (1, b"left", "l", 1, None, None),
        (1, b"left", "l", 1, None, None),
        (None, b"nokey", "l", 1, None, None),
        (1, b"two", "p", 1, T[3], None),
    ]
    b = [(1, b"same", "aa ", 5, T[5], "clash"), (1, b"old", "y", 3, T[0], None), (1, b"null", "", None, T[0], None), (1, b"right", None, 1, None, None), (1, b"two", None, 2, T[0], None)]
    fields = {"size": F.col("size"), "etag": F.nullif(F.regexp_replace(F.lower("etag"), r'["\s]', ""), F.lit(""))}
    d = diff(spark.createDataFrame(a, REP), spark.createDataFrame(b, REP), ["algo", "hash"], fields, version="at", only_left="L", only_right="R")
    assert rows(d) == [(1, b"left", "L"), (1, b"old", "size"), (1, b"right", "R"), (1, b"two", "etag"), (1, b"two", "size")]
    empty = spark.createDataFrame([], REP)
    assert diff(spark.createDataFrame(a, REP), empty, ["algo", "hash"], fields, version="at").count() == 5
    assert diff(empty, empty, ["algo", "hash"], fields, version="at").count() == 0


def test_current_rows_order_free(spark, rows):
    data = [(1, b"k", "e", i % 3, T[i % 4], None) for i in range(24)]
    fields = {"size": F.col("size")}
    want = rows(current_rows(spark.createDataFrame(data, REP), ["algo", "hash"], fields, "at"))
    random.Random(1).shuffle(data)
    assert rows(current_rows(spark.createDataFrame(data, REP), ["algo", "hash"], fields, "at")) == want == [(1, b"k", 2)]


def test_orphans(spark, rows):
    parents = spark.createDataFrame([("p", T[2], None), ("p", T[5], T[6]), ("gone", T[0], T[1]), ("late", T[4], None), (None, T[0], None), ("never", None, None)], "key string, made timestamp, dead timestamp")
    refs = spark.createDataFrame([("p", T[3]), ("p", T[1]), ("gone", T[3]), ("late", T[3]), ("late", T[8]), ("no", T[3]), ("no", T[3]), ("no", None), (None, T[3]), ("never", T[1]), ("p", None)], "key string, made timestamp")
    got = orphans({"t": reference_summary(refs, "key", "made")}, parent_summary(parents, "key", "made", "dead"))
    want = [("gone", "2024-04", "deleted", 1), ("late", "2024-04", "late", 1), ("no", None, "missing", 1), ("no", "2024-04", "missing", 2), ("p", "2024-02", "late", 1)]
    assert rows(got, "key", "ref_month", "reason", "n_refs") == want
    # a filter of one word lets nearly everything through: the join must then decide
    full = orphans({"t": reference_summary(refs, "key", "made")}, parent_summary(parents, "key", "made", "dead"), n_words=1)
    assert rows(full, "key", "ref_month", "reason", "n_refs") == want
    none = orphans({"t": reference_summary(refs, "key", "made")}, parent_summary(parents.limit(0), "key", "made", "dead"))
    assert {r.reason for r in none.collect()} == {"missing"}
    assert orphans({"t": reference_summary(refs.limit(0), "key", "made")}, parent_summary(parents, "key", "made", "dead")).count() == 0


def test_dense_totals(spark, rows):
    data = [("A", 1 << 40, T[0]), ("a ", (1 << 40) + 1, T[2]), ("b", None, None), (None, 7, T[1]), ("b", -3, None)] + [("hot", 1, T[3])] * 1000
    d = dense_totals(spark.createDataFrame(data, "k string, n bigint, at timestamp").repartition(7), "k", F.col("n"), F.col("at"), I.trimmed)
    assert rows(d, "key", "n_rows", "n_bytes", F.col("last_at").cast("string")) == [(None, 1, 7, str(T[1])), ("a", 2, (1 << 41) + 1, str(T[2])), ("b", 2, -3, None), ("hot", 1000, 1000, str(T[3]))]
    assert dense_totals(spark.createDataFrame([], "k string, n bigint, at timestamp"), "k", F.col("n"), F.col("at")).count() == 0
