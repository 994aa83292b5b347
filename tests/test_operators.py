"""Stream, range, block, format, catalog and governance operators on small inputs with known results."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.functions import codecs as K
from blockloom.functions import digests as D
from blockloom.operators import catalog as C
from blockloom.operators import chunking as B
from blockloom.operators import govern as G
from blockloom.operators import ranges as R
from blockloom.operators import store as S
from blockloom.operators import transduce as X
from blockloom.plans import algebra as A


def stream(spark, values, kind="string"):
    data = [("s", i, v) for i, v in enumerate(values)]
    random.Random(3).shuffle(data)
    return spark.createDataFrame(data, f"k string, i bigint, v {kind}")


P, O = ["k"], ["i"]  # noqa: E741


# ---- streams ----
def test_ema(spark):
    d = stream(spark, [10.0, 20.0, 30.0], "double")
    assert [r.ema for r in X.ema_running(d, P, O, "v", 0.5).orderBy("i").collect()] == [10, 15, 22.5]
    assert X.ema(d, P, O, "v", 0.5).first()[1:] == (22.5, 3)
    assert X.ema(d, P, O, "v", 0.5, start=0.0).first()[1] == 0.5 * (0.5 * 5 + 10) + 15
    assert abs(X.ema(d, P, O, "v", 7).first()[1] - 29.99) < 0.1  # alpha is kept below 1


def test_dedup_batches_runs(spark, rows):
    d = stream(spark, "abacbd")
    assert [r.v for r in X.dedup(d, P, O, ["v"]).orderBy("i").collect()] == list("abcd")
    assert rows(X.dedup_summary(d, P, ["v"])) == [("s", 4, 2)]
    b = X.batches(stream(spark, range(1, 8), "int"), P, O, "v", 3)
    assert rows(b, "batch", "items") == [(0, (1, 2, 3)), (1, (4, 5, 6)), (2, (7,))]
    r = X.run_groups(stream(spark, "aabbbac"), P, O, "v").orderBy("run").collect()
    assert [(x.v, x.n) for x in r] == [("a", 2), ("b", 3), ("a", 1), ("c", 1)]
    nulls = X.run_groups(stream(spark, [None, None, "a", None]), P, O, "v").orderBy("run").collect()
    assert [(x.v, x.n) for x in nulls] == [(None, 2), ("a", 1), (None, 1)]


def test_segments_change_nothing(spark, rows):
    d = spark.range(500).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"))
    d = d.unionByName(spark.createDataFrame([(None, 1, 5), (None, 2, 6)], "k string, i bigint, v bigint"))
    sums = {"n": F.lit(1).cast("bigint"), "t": F.col("v")}
    assert rows(X.running_sum(d, P, O, sums)) == rows(X.running_sum(d, P, O, sums, F.floor(F.col("i") / 50)))


def test_guard_window_reservoir(spark):
    d = stream(spark, ["aa", "bbb", "cc", "d"])
    kept = X.bomb_guard(d, P, O, F.octet_length("v"), 5).orderBy("i").collect()
    assert [r.v for r in kept] == ["aa", "bbb"]  # exactly the limit passes, what follows doesn't
    assert X.bomb_summary(d, P, F.octet_length("v"), 5).first()[1:] == (8, True, 5)
    assert [r.window for r in X.sliding(d, P, O, "v", 0).orderBy("i").collect()] == [["aa"], ["bbb"], ["cc"], ["d"]]
    big = stream(spark, range(1000), "int")
    one, two = ({r.v for r in X.reservoir(big.repartition(n), P, ["i"], 20).collect()} for n in (1, 9))
    assert one == two and len(one) == 20 and X.reservoir(big, P, ["i"], 0).count() == 0


def test_annotate_and_hash(spark):
    d = stream(spark, [b"\x01\x02", b"\x80", b""], "binary")
    got = [(r.byte_sum, r.window_total, r.flagged) for r in X.window_annotate(d, P, O, "v", 2).orderBy("i").collect()]
    assert got == [(3, 3, False), (128, 131, True), (0, 128, True)]

    def h31(b):
        h = 1
        for x in b:
            h = (31 * h + (x - 256 if x > 127 else x) + 2**31) % 2**32 - 2**31
        return h

    data = [random.Random(i).randbytes(40) for i in range(5)]
    d = stream(spark, data, "binary")
    assert [r[0] for r in d.orderBy("i").select(X.hash31("v")).collect()] == [h31(b) for b in data]
    s = X.short_circuit(stream(spark, [b"ab", b"cd"], "binary"), P, O, "v", b"bc", "why").first()
    assert s.stopped and s.frames == 2
    assert not X.short_circuit(stream(spark, [b"\x1a", b"\xb0"], "binary"), P, O, "v", b"\xab", "why").first().stopped
    assert not X.short_circuit(stream(spark, [b"x"], "binary"), P, O, "v", b"", "why").first().stopped


def test_telemetry(spark):
    d = stream(spark, [b"%P", b"DF-1", b"xx"], "binary")
    got = [(r.route, r.ordinal, r.bytes, r.mime_hint, r.halted) for r in X.telemetry_steps(d, P, O, "v", 5, 4).orderBy("ordinal").collect()]
    assert got == [("small", 1, 2, None, False), ("large", 2, 6, "application/pdf", True), ("small", 3, 8, "application/pdf", True)]
    f = X.telemetry_final(d, P, O, "v").first()
    assert (f.bytes, f.chunks, f.mime_hint) == (8, 3, "application/pdf")


def test_empty_streams(spark):
    e = spark.createDataFrame([], "k string, i bigint, v string")
    for out in (X.counter(e, P, O), X.dedup(e, P, O, ["v"]), X.batches(e, P, O, "v", 2), X.run_groups(e, P, O, "v"), X.sliding(e, P, O, "v", 2), X.byte_counter(e, P, O, "v")):
        assert out.count() == 0


def test_programs(spark):
    d = stream(spark, [1, 2, 3, 4], "int")
    p = A.Id() >> A.where(F.col("v") > 1) >> (A.where(F.col("v") < 4) >> A.Map({"v": F.col("v") * 10}))
    assert A.fuse(p).describe() == "Filter(2) >> Map(v)"
    assert sorted(r.v for r in p.run(d, P, O).collect()) == [20, 30]
    twice = A.FlatMap("x", F.array("v", "v"))
    step = A.par(twice, A.FlatMap("y", F.array("v")), ["x"], ["y"]).run(d, P, O)
    assert sorted((r.x, r.y) for r in step.collect()) == [(1, 1), (2, 2), (3, 3), (4, 4)]  # the second of each pair is dropped
    buffered = A.par(twice, A.FlatMap("y", F.array("v")), ["x"], ["y"], "buffered").run(d, P, O)
    assert sorted((r.x, r.y) for r in buffered.collect()) == [(1, 1), (1, 2), (2, 3), (2, 4)]
    with pytest.raises(ValueError):
        A.par(A.Id(), A.Id(), ["x"], ["x"])
    with pytest.raises(ValueError):
        X.merge_structs(F.col("a"), F.col("b"), ["n"], ["n"])
    tail = A.Scan(A.counter("n"), lambda x, c: x.groupBy(*c.part).agg(F.count(F.lit(1)).alias("n")), ("n",)).run(d, P, O)
    assert sorted((r.n, r.is_tail) for r in tail.collect()) == [(1, False), (2, False), (3, False), (4, False), (4, True)]
    assert A.Zero().run(d, P, O).count() == 0


# ---- ranges ----
def spans(spark, *xs):
    return spark.createDataFrame([("s", a, b) for a, b in xs], "k string, start bigint, end bigint")


def get(df):
    return sorted((r.start, r.end) for r in df.collect())


def test_ranges_known(spark):
    s = spans(spark, (0, 4), (10, 12))
    assert get(R.complement(s, spans(spark, (0, 20)), P)) == [(5, 9), (13, 20)]
    v = spark.createDataFrame([("s", x) for x in (2, 5, 11)], "k string, v bigint")
    assert [r.contained for r in R.contains_values(s, v, P, "v").orderBy("v").collect()] == [True, False, True]
    assert get(R.complement(spans(spark, (0, 5000), (6000, 10000)), spans(spark, (0, 10000)), P)) == [(5001, 5999)]
    assert get(R.normalize(spans(spark, (0, 5), (4, 10), (20, 25)), P)) == [(0, 10), (20, 25)]
    t = spans(spark, (0, 5), (10, 12))
    assert R.covered_length(t, P).first()[1] == 9
    assert get(R.missing_within(t, spans(spark, (0, 15)), P)) == [(6, 9), (13, 15)]
    u = spans(spark, (0, 5), (10, 15))
    assert get(R.next_gap(u, P, 0)) == [(6, 9)] and get(R.next_gap(u, P, 7)) == [(7, 9)] and get(R.next_gap(u, P, 11)) == []
    assert get(R.next_gap(spans(spark, (5, 9)), P, 2)) == [(2, 4)]
    assert get(R.normalize(spans(spark, (3, 1), (None, 4)), P)) == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-30, 60), st.integers(0, 12)), max_size=12), st.lists(st.tuples(st.integers(-30, 60), st.integers(0, 12)), max_size=12))
def test_ranges_brute(spark, a, b):
    a, b = ([(s, s + n) for s, n in x] for x in (a, b))
    pts = lambda xs: {p for s, e in xs for p in range(s, e + 1)}
    da, db = spans(spark, *a), spans(spark, *b)
    for df, want in ((R.union(da, db, P), pts(a) | pts(b)), (R.intersect(da, db, P, 8), pts(a) & pts(b)), (R.difference(da, db, P), pts(a) - pts(b)), (R.normalize(da, P, 16), pts(a))):
        got = get(df)
        assert pts(got) == want
        assert all(x[1] + 1 < y[0] for x, y in zip(got, got[1:]))


def test_span_algebra(spark):
    c = lambda *v: [F.lit(x) for x in v]
    d = spark.range(1).select(
        R.merge(*c(0, 4, 5, 9)).alias("m"), R.merge(*c(0, 4, 6, 9)).alias("n"), R.intersection(*c(0, 4, 3, 9)).alias("i"), R.subtract(*c(0, 9, 3, 4)).alias("s"), R.subtract(*c(0, 2, 3, 4)).alias("k"), R.subtract(*c(3, 4, 0, 9)).alias("z")
    ).first()
    assert tuple(d.m) == (0, 9) and d.n is None and tuple(d.i) == (3, 4) and [tuple(x) for x in d.s] == [(0, 2), (5, 9)] and [tuple(x) for x in d.k] == [(0, 2)] and d.z == []


# ---- blocks ----
def objects(spark, *xs):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id int, data binary")


def test_fixed(spark):
    for n, size, want in ((6, 3, [3, 3]), (10, 4, [4, 4, 2]), (0, 4, []), (2, 0, [1, 1])):
        d = B.fixed_blocks(objects(spark, bytes(n), None), ["id"], "data", size).orderBy("block_index")
        assert [len(r.block) for r in d.collect()] == want


def test_delimiter():
    d = b"a\nbb\nccc"
    assert B.delimiter_cuts(d, b"\n", True, 1, 16) == [b"a\n", b"bb\n", b"ccc"]
    assert B.delimiter_cuts(d, b"\n", False, 1, 16) == [b"a", b"bb", b"ccc"]
    assert B.delimiter_cuts(b"\n\nx\n", b"\n", False, 1, 16) == [b"x"]
    with pytest.raises(ValueError):
        B.delimiter_cuts(d, b"", True, 1, 16)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(x % 3 + 97 for x in b)), st.sampled_from([b"a", b"ab", b"aab", b"aa"]), st.booleans(), st.integers(1, 8), st.integers(1, 20))
def test_delimiter_by_bytes(data, delim, include, lo, hi):
    hi, out, start = max(lo, hi), [], 0
    for i in range(1, len(data) + 1):
        b = data[start:i]
        cut = len(b) >= lo and b.endswith(delim)
        if cut or len(b) >= hi:
            out.append(b[: -len(delim)] if cut and not include else b)
            start = i
    out.append(data[start:])
    assert B.delimiter_cuts(data, delim, include, lo, hi) == [b for b in out if b]


def test_cdc_known():
    import hashlib

    g = B.gear_table()
    assert [f"{x:08x}" for x in g[:4]] == ["174a4bfe", "161c0364", "77a5c34d", "80401e3c"]
    assert hashlib.sha256(b"".join(int(x).to_bytes(4, "big") for x in g)).hexdigest() == "c198f4a020b41c5826755f52522752faf5d45a4e4dacdfa6294422339bcba885"
    assert B.cdc_masks(1024) == (0x1FF, 0x3FF)
    assert B.fast_cdc(bytes(i % 256 for i in range(10000)), 256, 1024, 2048) == [2048] * 4 + [1808]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000), st.sampled_from([(64, 256, 1024), (256, 1024, 4096), (16, 64, 300), (1, 64, 100)]))
def test_cdc_same_as_bytes(data, conf):
    lo, avg, hi = B.cdc_bounds(*conf)
    sizes = B.fast_cdc(data, *conf)
    assert sizes == B._cdc_bytes(data, lo, avg, hi, *B.cdc_masks(avg), B.gear_table())
    assert sum(sizes) == len(data) and all(lo <= s <= hi for s in sizes[:-1])


def test_cdc_resists_shifts():
    r = random.Random(5)
    data = r.randbytes(128 * 1024)
    moved = data[:1024] + r.randbytes(37) + data[1024:]

    def keys(d, sizes):
        at, out = 0, set()
        for n in sizes:
            out.add(d[at : at + n])
            at += n
        return out

    a, b = (keys(d, B.fast_cdc(d, 256, 1024, 4096)) for d in (data, moved))
    assert len(a & b) / len(a) > 0.8
    fixed = lambda d: {d[i : i + 1024] for i in range(0, len(d), 1024)}
    assert len(fixed(data) & fixed(moved)) / len(fixed(data)) < 0.1


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=900).map(lambda b: bytes(x % 5 + 97 for x in b)), st.sampled_from([(16, 64, 200), (2, 64, 200), (8, 16, 30), (1, 1, 9), (3, 3, 3)]), st.sampled_from([b"", b"a", b"ab", b"aab", b"abab", b"aaa"]))
def test_anchored_by_bytes(data, conf, anchor):
    """Against the state machine walked byte by byte."""
    lo, avg, hi = B.cdc_bounds(*conf)
    mask = (1 << (max(1, (avg - 1).bit_length()) - 1)) - 1
    roll = n = ai = 0
    want = []
    for b in data:
        n += 1
        roll = ((roll << 1) ^ b) & 0xFFFFFF
        hit = False
        if anchor:
            if b == anchor[ai]:
                ai += 1
                if ai == len(anchor):
                    hit, ai = True, 0
            else:
                ai = 1 if b == anchor[0] else 0
        why = "anchor" if hit and n >= lo else "max" if n >= hi else "roll" if n >= lo and roll & mask == 0 else None
        if why:
            want.append((n, why))
            n = roll = 0
    assert B.anchored_cdc(data, *conf, anchor) == want + [(n, "eof")] * (n > 0)


def test_anchored():
    d = b"AAAA" + b"A" * 3000 + b"endstream" + b"B" * 3000
    out = B.anchored_cdc(d, 256, 1024, 4096, b"endstream")
    assert sum(n for n, _ in out) == len(d) and out[-1][1] == "eof" and "anchor" in [w for _, w in out]


def test_rechunk_any_split(spark, rows):
    data = random.Random(2).randbytes(3000)
    want = [data[i : i + 700] for i in range(0, 3000, 700)]
    for step in (1000, 64, 7):
        parts = [("s", i, data[i : i + step]) for i in range(0, len(data), step)] + [("s", -1, b""), ("s", -2, None)]
        d = B.rechunk(spark.createDataFrame(parts, "k string, i bigint, b binary"), P, O, "b", 700)
        assert [bytes(r.block) for r in d.orderBy("block_index").collect()] == want
    assert B.rechunk_summary(spark.createDataFrame([("s", 0, data)], "k string, i bigint, b binary"), P, "b", 700).first()[1:] == (3000, 4, 0)


# ---- formats ----
KEY = K.Key("block", "sha-256", "ab" * 32, 5)


def test_key_formats():
    view = K.Key("view", "sha-1", "cd" * 20, 0, "thumb", (("a", "1"), ("b", "2")), "s")
    for k in (KEY, view):
        r = K.Reader(K.encode_key(k))
        assert K.read_key(r) == k
        r.done()
    for bad in (K.Key("blob", "sha-256", "ab" * 32, 0), K.Key("block", "sha-1", "ab" * 32, 5), K.Key("block", "sha-256", "zz" * 32, 5)):
        with pytest.raises(K.CodecError):
            K.encode_key(bad)


def test_manifest_formats():
    es = [K.Entry(KEY, 0, 4, {"b": "2", "a": "1"}), K.Entry(KEY, 7, 11)]
    raw = K.encode_manifest(es, 12)
    assert K.decode_manifest(raw) == (es, 12)
    for data in (raw[:-1], raw + b"\0", b"\2" + raw[1:]):
        with pytest.raises(K.CodecError):
            K.decode_manifest(data)
    for entries, size in ((es, 11), ([es[1], es[0]], 5), ([es[0], K.Entry(KEY, 4, 9)], 10)):
        with pytest.raises(K.CodecError):
            K.encode_manifest(entries, size)
    m = K.Key("manifest", "sha-256", "ab" * 32, 9)
    assert K.decode_root(K.encode_root([K.Page(m, 0, 4, 3)], 5)) == ([K.Page(m, 0, 4, 3)], 5)
    with pytest.raises(K.CodecError):
        K.encode_root([K.Page(KEY, 0, 4, 3)], 5)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=50), st.none() | st.text(max_size=5), st.none() | st.binary(max_size=5), st.none() | st.integers(-(2**63), 2**63 - 1), st.booleans(), st.integers(1, 40))
def test_frames(payload, name, raw, index, keyed, step):
    f = K.Frame(payload, "manifest", "encrypted", 1, name, raw, name, KEY if keyed else None, index, name, (("k", "v"),) * 2, raw)
    data = K.encode_frame(f)
    assert K.decode_frame(data) == (f, len(data))
    many = data * 3
    assert K.decode_stream([many[i : i + step] for i in range(0, len(many), step)], K.decode_frame) == [f] * 3
    assert K.decode_stream([many], K.decode_frame, many=False) == [f]
    with pytest.raises(K.NeedMore):
        K.decode_stream([many[:-1]], K.decode_frame)
    assert K.decode_stream([many[:-1]], K.decode_frame, strict=False) == [f] * 2
    with pytest.raises(NotImplementedError):
        K.frame_block(b"x", "zstd")


def test_http_and_records():
    assert K.http_chunks(b"4\r\nWiki\r\n5\r\npedia\r\n0\r\n\r\n") == [b"Wiki", b"pedia"]
    assert K.http_chunks(b"A;foo=bar\r\nHelloWorld\r\n0\r\nSome: header\r\n\r\n") == [b"HelloWorld"]
    for data, why in ((b"1\r\nA0\r\n\r\n", "no CR behind a chunk"), (b"2\r\nA", "the body ends inside a chunk"), (b"x\r\n", "no chunk size: 'x'")):
        with pytest.raises(K.CodecError, match=why):
            K.http_chunks(data)
    assert K.fixed_records([b"\0\1", b"\2\3\4"], 3) == ([b"\0\1\2"], b"\3\4")


def test_view_key(spark):
    import hashlib

    d = spark.createDataFrame([("sha-256", "ab" * 32, 7)], "a string, d string, s bigint")
    args = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    got = d.select(D.view_key(F.col("a"), F.col("d"), F.col("s"), F.lit("n"), args, F.lit(None).cast("string"), "pre")).first()[0]
    u = lambda b: len(b).to_bytes(4, "big") + b
    raw = b"pre" + b"\1" + u(b"sha-256") + u(bytes.fromhex("ab" * 32)) + (7).to_bytes(8, "big") + b"\1" + u(b"n") + b"\0" + (2).to_bytes(4, "big") + u(b"a") + u(b"1") + u(b"b") + u(b"2")
    assert got == f"sha-256:{hashlib.sha256(raw).hexdigest()}:0"
    bad = d.select(D.deterministic_args(F.create_map(F.lit(" Seed"), F.lit("1")))).first()[0]
    assert bad is False
    with pytest.raises(NotImplementedError):
        D.hashed(F.col("d"), "blake3")


# ---- store ----
def test_round_trip_and_damage(spark, rows):
    r = random.Random(9)
    data = [r.randbytes(n) for n in (1, 64, 1000, 1000)] + [b"", None]
    objs = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(data)], "id int, data binary")
    blocks, manifest = S.ingest_bytes(objs, "id", "data", 100)
    back = S.read_back(manifest, blocks, "id")
    assert {x.id: bytes(x.data) for x in back.collect()} == {i: data[i] for i in range(4)}
    assert all(not x.violations for x in S.validate_manifest(manifest, "id").collect())
    put = S.put_blocks(blocks, ["id", "block_index"])
    again = S.put_blocks(blocks, ["id", "block_index"], put.where("status = 'Fresh'"))
    assert again.where("status = 'Fresh'").count() == 0
    stats = S.ingest_stats(put.withColumn("all", F.lit(1)), ["all"]).first()
    assert (stats.block_count, stats.duplicate_blocks) == (22, 0)
    broken = S.read_back(manifest, blocks.where("id <> 2 or block_index <> 3"), "id")
    assert {x.id: x.missing for x in broken.collect()} == {0: 0, 1: 0, 2: 1, 3: 0}
    bad = manifest.withColumn("start", F.when((F.col("id") == 2) & (F.col("ordinal") == 4), F.col("start") - 5).otherwise(F.col("start")))
    assert {x.id: x.violations for x in S.validate_manifest(bad, "id").where("size(violations) > 0").collect()} == {2: ["overlap at 4"]}
    assert S.delete(manifest, objs.where("id = 2"), "id").where("id = 2").count() == 0


def test_first_of_repeated_keys(spark):
    b = spark.createDataFrame([("k", 2), ("k", 1), ("k", 3), (None, 0), ("z", 9)], "block_key string, i int")
    got = {(r.block_key, r.i): r.status for r in S.put_blocks(b, ["i"]).collect()}
    assert got == {("k", 1): "Fresh", ("k", 2): "Duplicate", ("k", 3): "Duplicate", ("z", 9): "Fresh"}


def test_stored_blobs_of_any_size(spark):
    """Hashed and read block by block: three blobs, one with a block missing, one with another digest than expected."""
    import hashlib

    data = [("a", random.Random(1).randbytes(10240)), ("b", b"x" * 700), ("c", b"y" * 10)]
    objects = spark.createDataFrame(data, "id string, data binary")
    blocks, manifest = S.ingest_bytes(objects, "id", "data", 100)
    want = spark.createDataFrame([(i, hashlib.sha256(d if i != "c" else b"other").hexdigest()) for i, d in data], "id string, expected string")
    assert {(r.id, r.ok) for r in S.verify_stored(manifest, blocks, "id", want).collect()} == {("a", True), ("b", True), ("c", False)}
    part = blocks.where("id <> 'a' or block_index <> 5")
    assert {(r.id, r.ok, r.actual is None) for r in S.verify_stored(manifest, part, "id", want).collect()} == {("a", False, True), ("b", True, False), ("c", False, False)}
    back = {}
    for r in S.read_rows(manifest, blocks, "id").toLocalIterator():
        assert r.start == len(back.get(r.id, b""))
        back[r.id] = back.get(r.id, b"") + r.data
    assert back == dict(data)
    keys = blocks.where("id = 'a'").selectExpr("id as k", "block_index", "block_key as expected")
    chunks = [("a", i, data[0][1][i * 77 : i * 77 + 77]) for i in range(-(-len(data[0][1]) // 77))]
    got = S.verify_stream(spark.createDataFrame(chunks, "k string, i bigint, v binary"), ["k"], ["i"], "v", 100, keys)
    assert {r.result for r in got.collect()} == {"Passed"} and got.count() == 103


def test_type_hint_behind_empty_chunks(spark):
    d = stream(spark, [b""] * 20 + [b"%P", None, b"DF-1.7"], "binary")
    assert [r.mime_hint for r in X.telemetry_steps(d, P, O, "v", 0).orderBy("i").collect()][-2:] == [None, "application/pdf"]
    assert X.telemetry_final(d, P, O, "v").first().mime_hint == "application/pdf"


def test_spans_of_any_length(spark):
    """No row per unit: spans of 2 ** 50."""
    far = 1 << 50
    a = spark.createDataFrame([("x", 0, far), ("x", far + 10, far + 20), ("y", -far, 5)], "k string, start bigint, end bigint")
    b = spark.createDataFrame([("x", 7, 9), ("x", far - 1, far + 15)], "k string, start bigint, end bigint")
    for width in (None, 1 << 40):
        assert sorted(map(tuple, R.intersect(a, b, P, width).collect())) == [("x", 7, 9), ("x", far - 1, far), ("x", far + 10, far + 15)]
        v = spark.createDataFrame([("x", 5), ("x", far + 5), ("x", far + 20), ("x", None), ("y", -far), ("y", 6), ("z", 1), ("x", 5)], "k string, v bigint")
        got = sorted((r.k, r.v or 0, r.contained) for r in R.contains_values(a, v, P, "v", width).collect())
        assert got == sorted([("x", 5, True), ("x", far + 5, False), ("x", far + 20, True), ("x", 0, False), ("y", -far, True), ("y", 6, False), ("z", 1, False), ("x", 5, True)])


# ---- catalog ----
def test_checks(spark):
    d = spark.createDataFrame([(1, "ab"), (7, "abc"), (None, None), (30, "x")], "n int, s string")
    ok = lambda text, col: [r[0] for r in d.select(C.parse_check(text, col)).collect()]
    assert ok("CHECK ((n >= 5) AND (n < 30))", "n") == [False, True, True, False]
    assert ok("n BETWEEN 1 AND 7", "n") == [True, True, True, False]
    assert ok("CHECK (char_length(s) > 1)", "s") == [True, True, True, False]
    assert ok("s NOT IN ('ab', 'it''s')", "s") == [False, True, True, True]
    assert ok("n IS NOT NULL", "n") == [True, True, False, True]
    assert ok("(s <> 'x'::text)", "s") == [True, True, True, False]
    assert ok("((n)::integer >= 1) AND ((n) < 30.5::numeric(4, 1))", "n") == [True, True, True, True]
    assert ok("CHECK ((\"n\" <> (7)::bigint))", "n") == [True, False, True, True]
    assert ok("octet_length((s)::character varying(9)) <= 2", "s") == [True, False, True, True]
    for bad in ("", "CHECK ()", "n > ", "n NOT 3", "length(n) > 'x'", "(n > 1", "n > 1)", "n ~ 'a'", "n > 1 AND n < 9 AND n < 8", "n > 1 AND n > 2", "f(n) = 2", "other > 3", "n > 1 OR n < 0"):
        with pytest.raises(ValueError):
            C.parse_check(bad, "n")


def test_best_location_matches_rank(spark, rows):
    r = random.Random(4)
    data = [(r.randint(0, 9), i, r.randint(0, 2), r.choice([None, *range(3)]), r.randint(0, 2)) for i in range(200)]
    d = spark.createDataFrame(data, "block int, loc int, sector_priority int, v int, w int")
    d = d.select("block", "loc", "sector_priority", F.timestamp_seconds("v").alias("verified_at"), F.timestamp_seconds("w").alias("written_at"))
    assert rows(C.best_location(d, ["block"], ["loc"]), "block", "loc") == rows(C.best_locations(d, ["block"], ["loc"], 1), "block", "loc")
    assert C.best_locations(d, ["block"], ["loc"], -1).count() == 0


def test_upserts_and_feed(spark, rows):
    base = spark.createDataFrame([(1, "a", 3), (2, "b", 1)], "id int, v string, version int")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    assert rows(C.upsert(base, new, ["id"], "version")) == [(1, "a", 3), (2, None, 2), (3, "c", 1)]
    assert rows(C.insert_new(base.drop("version"), new, ["id"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(C.change_feed(base.drop("version"), new, ["id"]), "id", "op") == [(1, "DELETE"), (2, "UPDATE"), (3, "INSERT")]
    p = C.page(base, [F.asc("id")], 1, 1).collect()
    assert [(r.id, r.total) for r in p] == [(2, 2)]
    assert C.own_rows(spark.createDataFrame([("x",), (None,), ("y",)], "org_id string"), "x", shared=True).count() == 2


def test_overlaps_and_schema(spark, rows):
    s = spark.createDataFrame([("b", 0, 0, 9), ("b", 1, 9, 20), ("b", 2, 21, 30), ("c", 0, 0, 99)], "k string, ordinal int, start bigint, end bigint")
    assert rows(C.overlapping_spans(s, ["k"], 4), "k", "a", "b") == [("b", 0, 1)]
    nodes, edges = C.schema_graph(spark.createDataFrame([], "a int, b array<struct<c: string>>, m map<string, bigint>").schema)
    kinds = {k for _, k, _ in nodes}
    assert kinds == {"Product", "Collection", "Optional", "Primitive"} and {a for a, _, _ in edges} <= {p for p, _, _ in nodes}


# ---- governance ----
def test_masks(spark):
    d = spark.createDataFrame([("blob.read  doc.read nope",), ("",), (None,)], "s string")
    assert [r[0] for r in d.select(G.scope_mask(F.col("s"))).collect()] == [9, 0, 0]
    e = spark.createDataFrame([("u", "allow", 3), ("u", "deny", 2), ("v", "deny", 1), ("w", "other", 7)], "u string, effect string, capabilities bigint")
    m = {r.u: (r.allow, r.deny) for r in G.acl_masks(e, ["u"]).collect()}
    assert m == {"u": (3, 2), "v": (0, 1), "w": (0, 0)}
    assert spark.range(1).select(G.effective_mask(F.lit(4).cast("bigint"), F.lit(3).cast("bigint"), F.lit(2).cast("bigint"))).first()[0] == 5


@pytest.mark.parametrize("segment", [None, 1, 3, 100])
def test_chain(spark, segment):
    zero = bytes(32)
    good = [("a", i, zero if i == 1 else bytes([i - 1]) * 32, bytes([i]) * 32) for i in range(1, 11)]
    bad = [("b", *x[1:]) for x in good]
    bad[5] = ("b", 6, b"?", bad[5][3])
    start = [("c", *x[1:]) for x in good[1:4]]
    d = spark.createDataFrame([*good, good[3], *bad, *start], "o string, seq bigint, p binary, h binary")
    got = {r.o: (r.ok, r.broken_at, r.total) for r in G.chain_breaks(d, ["o"], "seq", "p", "h", segment).collect()}
    assert got == {"a": (True, None, 10), "b": (False, 6, 6), "c": (False, 2, 1)}


def test_latches():
    s, got = (10, 0), []
    for now, n in ((0, 6), (0, 6), (500, 6), (500, 6), (2000, 10)):
        s, ok = G.take_tokens(s, now, n, 10)
        got.append(ok)
    assert got == [True, False, True, False, True]
    # a refused take keeps its refill but not its tick: the same 100 ms refill twice
    s, ok = G.take_tokens((0, 0), 100, 5, 10)
    assert not ok and s == (1, 0) and G.take_tokens(s, 100, 2, 10)[1]
    s, seen = ("closed", 0), []
    for now, ok in ((0, False), (1, False), (2, True), (10, True), (11, False), (12, False), (13, True), (40, False), (41, True)):
        s, went = G.step_breaker(s, now, ok, 2, 8)
        seen.append((went, s[0]))
    assert seen == [(True, "closed"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed"), (True, "open"), (False, "open"), (True, "open"), (False, "open")]


def test_quota_and_prometheus(spark):
    d = stream(spark, [5, 4, 3, 1, None], "int")
    assert G.quota(d, P, O, "v", 10).first()[1:] == (10, 3, 1)
    m = spark.createDataFrame([("n", {"b": 'x"\\', "a": "1\n"}, 2), ("g", {}, 5)], "name string, tags map<string,string>, value int")
    assert [r.line for r in G.prometheus_lines(m).collect()] == ['n{a="1\\n",b="x\\"\\\\"} 2', "g 5"]
    h = {r.bucket: r.n for r in G.histogram(spark.createDataFrame([(-1500,), (-5,), (5,), (2048,), (None,)], "v int"), "v").collect()}
    assert h == {-1: 1, 0: 2, 2: 1}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=25))
def test_components(spark, edges):
    root = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in G.connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == root


def test_components_of_a_chain(spark):
    n = 300
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "a int, b int")
    assert {r.root for r in G.connected_components(e).collect()} == {0}
    assert G.connected_components(e.limit(0)).count() == 0


def test_candidates_across_stretches():
    data = random.Random(8).randbytes(5000)
    import numpy as np

    for few, many in ((0x3F, 0xFF), (0x1FF, 0x3FF), (0x3FFF, 0x1FFFF)):
        whole = B._candidates(data, B.gear_table(), np.add, few, many)
        for step in (7, 64, 1000):
            assert all((x == y).all() for x, y in zip(whole, B._candidates(data, B.gear_table(), np.add, few, many, step)))


def test_ancestors_of_long_chains_and_cycles(spark, rows):
    """A chain of 200, a tree, two parents of unequal chains, a null parent, and a cycle with a tail."""
    edges = [(i, i + 1) for i in range(200)]
    edges += [(1001, 1000), (1002, 1000), (1003, 1001), (1004, 1003), (1004, 1002)]
    edges += [(2000, None), (2001, 2000), (3000, 3001), (3001, 3002), (3002, 3000), (3003, 3000), (3004, 3003), (4000, 4000)]
    got = {r.child: (r.root, r.depth) for r in C.ancestors(spark.createDataFrame(edges, "child int, parent int")).collect()}
    want = {i: (200, 200 - i) for i in range(200)}
    want |= {1001: (1000, 1), 1002: (1000, 1), 1003: (1000, 2), 1004: (1000, 3), 2000: (None, 1), 2001: (None, 2)}
    assert got == want | dict.fromkeys([3000, 3001, 3002, 3003, 3004, 4000], (None, None))
    assert C.ancestors(spark.createDataFrame(edges[:0], "child int, parent int")).count() == 0
