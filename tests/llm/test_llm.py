"""The operators for training data: brute force, round trips, held-out accuracy and edge cases."""

import datetime as dt
import html
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from comparing import DATA, assert_same, connect
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.llm import history_dedup as H
from blockloom.llm import leakage as L
from blockloom.llm import mixing as X
from blockloom.llm import packing as P
from blockloom.llm import queries as Q
from blockloom.llm import reading_level as R
from blockloom.llm import runs as N
from blockloom.llm import seen_keys as S

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, con, name):
    assert_same(spark, con, Q.QUERIES[name], Q.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    df = Q.QUERIES[name](spark, f"{DATA}/{SF}")
    assert df.count() == df.distinct().count() > 0


# ---- p1 ----
def ingests(seed, n=120):
    """(ingest, batch, set): copies, near copies, subsets, and one fingerprint that a third of all ingests hold."""
    r, out = random.Random(seed), []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.55:
            base = set(r.choice(out)[2])
            for _ in range(r.randint(0, 1 + len(base) // 4)):
                if base and r.random() < 0.5:
                    base.discard(r.choice(sorted(base)))
                else:
                    base.add(f"n{r.random()}")
        else:
            base = {f"{i}-{k}" for k in range(r.choice([1, 2, 3, 10, 25]))}
        if r.random() < 0.35:
            base.add("hot")
        if r.random() < 0.05:
            base = {"hot"}
        out.append((1000 - i if r.random() < 0.5 else 2000 + i, r.randint(1, 6), base or {"x"}))
    return out


def brute_pairs(sets):
    return {(min(a, b), max(a, b)) for i, (a, x, s) in enumerate(sets) for b, y, t in sets[:i] if x != y and 10 * len(s & t) >= 7 * len(s | t)}


@pytest.mark.parametrize("seed,calls", [(1, 1), (2, 2), (3, 6), (4, 3)])
def test_history_finds_all_pairs(spark, seed, calls):
    sets = ingests(seed)
    data = [(i, b, f.encode()) for i, b, s in sets for f in s]
    data += data[::9] + [(data[0][0], data[0][1], None), (None, 1, b"x")]
    df = spark.createDataFrame(data, "ingest_id bigint, batch_id int, f binary")
    h = H.BatchHistory(spark, n_words=16 if seed == 4 else 1 << 12)
    bounds = [round(6 * k / calls) for k in range(calls + 1)]
    newest = set()
    for a, b in zip(bounds, bounds[1:]):
        h.accept(df.where((F.col("batch_id") > a) & (F.col("batch_id") <= b)))
        newest = {i for i, x, _ in sets if a < x <= b}
    got = {tuple(r) for r in h.pairs().collect()}
    assert got == brute_pairs(sets)
    assert {tuple(r) for r in h.pairs(since=calls - 1).collect()} == {p for p in got if newest & set(p)}


def test_history_large_sets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(H, "PART", 10)
    test_history_finds_all_pairs(spark, 5, 2)


@pytest.mark.parametrize("seed,order", [(11, [3, 1, 6, 2, 5, 4]), (12, [6, 5, 4, 3, 2, 1])])
def test_history_in_any_order_of_batches(spark, monkeypatch, seed, order):
    """Also with merged runs and with every frequent fingerprint treated as one that very many classes hold."""
    monkeypatch.setattr(H, "FAN", 2)
    monkeypatch.setattr(H, "PAIRS_PART", 5)
    monkeypatch.setattr(H, "hot_floor", lambda total: 5)
    sets = ingests(seed)
    df = spark.createDataFrame([(i, b, f.encode()) for i, b, s in sets for f in s], "ingest_id bigint, batch_id int, f binary")
    h = H.BatchHistory(spark, n_words=1 << 12)
    for b in order:
        h.accept(df.where(F.col("batch_id") == b))
    got = [tuple(r) for r in h.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(sets)
    assert max(len(r) for r in h.runs.values()) <= 3
    equal = lambda s: [i for i, _, t in sets if s == t]
    links = {i: sum(i in p for p in got) for i, _, _ in sets}
    assert sorted(tuple(r) for r in h.classes().collect()) == sorted((i, b, min(equal(s)), len(equal(s)), links[i]) for i, b, s in sets)


def test_history_two_orders_of_two_near_ingests(spark):
    rows = [(1, 3, bytes([k])) for k in range(10)] + [(2, 5, bytes([k])) for k in range(9)]
    df = spark.createDataFrame(rows, "ingest_id bigint, batch_id int, f binary")
    for order in ([3, 5], [5, 3]):
        h = H.BatchHistory(spark)
        for b in order:
            h.accept(df.where(F.col("batch_id") == b))
        assert [tuple(r) for r in h.pairs().collect()] == [(1, 2)]


def test_history_reads_what_a_call_needs(spark, monkeypatch):
    """A call of new content reads nothing of the store, one with few known ingests reads few ranges, however long the history is."""
    h, asked = H.BatchHistory(spark), []
    ids = spark.range(20000)
    data = ids.selectExpr("cast(floor(id / 20) as bigint) as ingest_id", "cast(floor(id / 4000) as int) as batch_id", "encode(cast(id as string), 'UTF-8') as f")
    counts = [h.accept(data.where(F.col("batch_id") == b)) for b in range(5)]
    assert all(c["ingests"] == 200 and c["fingerprints"] == 4000 and c["looked_up"] == c["ranges"] == 0 for c in counts)
    read = h.read
    monkeypatch.setattr(h, "read", lambda name, ranges=None: (asked.append((name, ranges)), read(name, ranges))[1])
    again = data.where("ingest_id in (7, 950)").selectExpr("ingest_id + 100000 as ingest_id", "9 as batch_id", "f").where("f <> encode('141', 'UTF-8')")
    c = h.accept(again.unionByName(ids.selectExpr("cast(floor(id / 20) as bigint) + 200000 as ingest_id", "9 as batch_id", "encode(concat('new', id), 'UTF-8') as f")))
    store = [r for name, r in asked if name == "prints"]
    assert len(store) == 1 and c["ranges"] == len(store[0]) <= 40 and c["looked_up"] <= 60
    width = sum(hi - lo + 1 for lo, hi in store[0])
    assert width < 0.01 * 2**64 and h.read("prints", store[0]).count() < 0.01 * 124000
    assert {tuple(r) for r in h.pairs(since=5).collect()} == {(7, 100007), (950, 100950)}


@pytest.mark.parametrize("few", [0, 10**6])
def test_history_of_large_calls_scans_the_store_once(spark, monkeypatch, few):
    """Also where more is asked for than is sent or broadcast at once, what is joined are the rows the store holds of it, not the store."""
    monkeypatch.setattr(H, "FEW", few)
    ids = spark.range(40000)
    data = ids.selectExpr("cast(floor(id / 20) as bigint) as ingest_id", "cast(floor(id / 8000) as int) as batch_id", "encode(cast(id as string), 'UTF-8') as f")
    h, asked, links = H.BatchHistory(spark), [], []
    h.accept(data)
    read, run = h.read, h._run
    monkeypatch.setattr(h, "read", lambda name, ranges=None: (asked.append(name), read(name, ranges))[1])
    monkeypatch.setattr(h, "_run", lambda name, df, level=0: (links.extend(df.inputFiles()) if name == "links" else None, run(name, df, level))[1])
    again = data.where("ingest_id % 50 = 7").selectExpr("ingest_id + 100000 as ingest_id", "9 as batch_id", "f").where("f <> encode('141', 'UTF-8')")
    assert h.accept(again)["looked_up"] > 0
    assert asked.count("prints") == 1 and links and not any("/prints/" in f for f in links)
    assert {tuple(r) for r in h.pairs(since=1).collect()} == {(i, i + 100000) for i in range(7, 2000, 50)}


@pytest.mark.parametrize("seed,few,send", [(21, 0, 10**6), (22, 0, 7), (23, 10**6, 7)])
def test_history_sends_what_it_asks_for_in_parts(spark, monkeypatch, seed, few, send):
    monkeypatch.setattr(H, "FEW", few)
    monkeypatch.setattr(H, "SEND", send)
    test_history_finds_all_pairs(spark, seed, 3)


@pytest.mark.parametrize("few", [0, 10**6])
def test_batches_of_ingests_in_several(spark, tmp_path, monkeypatch, few):
    """An ingest goes to its first batch whole, however many have to be moved."""
    monkeypatch.setattr(H, "FEW", few)
    rows = [(1, 2, b"a"), (1, 1, b"b"), (2, 2, b"a"), (2, 2, b"c"), (3, 3, b"x"), (3, 1, None), (None, 1, b"y"), (4, None, b"z")]
    assert H.by_batch(spark.createDataFrame(rows, "ingest_id bigint, batch_id int, f binary"), at := str(tmp_path / "b")) == [1, 2]
    got = {(r["batch_id"], r["ingest_id"], bytes(r["f"])) for r in spark.read.parquet(at).collect()}
    assert got == {(1, 1, b"a"), (1, 1, b"b"), (2, 2, b"a"), (2, 2, b"c"), (1, 3, b"x")}


def test_ranges():
    bits = lambda *s: sum(1 << i for i in s).to_bytes(4096, "little")
    w = 1 << 49
    assert N.ranges_of(None) == [] and N.ranges_of(bits()) == []
    assert N.ranges_of(bits(0, 1, 5, 32767)) == [(-w, 2 * w - 1), (5 * w, 6 * w - 1)]
    assert N.ranges_of(bits(16384)) == [(-(2**63), -(2**63) + w - 1)]
    many = N.ranges_of(bits(*range(0, 30000, 7)))
    assert len(many) == N.RANGES and all(any(lo <= (s - 32768 * (s >= 16384)) * w and ((s - 32768 * (s >= 16384)) + 1) * w - 1 <= hi for lo, hi in many) for s in range(0, 30000, 7))


def test_history_reopened(spark, tmp_path):
    sets = ingests(8)
    df = spark.createDataFrame([(i, b, f.encode()) for i, b, s in sets for f in s], "ingest_id bigint, batch_id int, f binary")
    at = str(tmp_path / "history")
    H.BatchHistory(spark, at, n_words=1 << 12).accept(df.where("batch_id <= 3"))
    h = H.BatchHistory(spark, at, n_words=1 << 12)
    assert h.calls == 1
    h.accept(df.where("batch_id > 3"))
    assert {tuple(r) for r in h.pairs().collect()} == brute_pairs(sets)


def test_history_empty(spark):
    h = H.BatchHistory(spark)
    h.accept(spark.createDataFrame([], "ingest_id bigint, batch_id int, f binary"))
    assert h.pairs().count() == 0
    h.accept(spark.createDataFrame([(1, 1, b"a"), (2, 2, b"a")], "ingest_id bigint, batch_id int, f binary"))
    assert [tuple(r) for r in h.pairs().collect()] == [(1, 2)]


def test_duplicate_blocks(spark):
    t = dt.datetime(2024, 1, 1)
    d = "ab" * 32
    data = [(1, 1, 0, d, t), (1, 1, 0, d, t), (1, 1, 1, f"0x{d.upper()}", t), (1, 1, 2, None, t), (2, 2, 0, f"sha256:{d}:5", t), (2, 2, 1, "cd" * 32, t)]
    df = spark.createDataFrame(data, "ingest_id bigint, batch_id int, block_index int, digest string, arrived_at timestamp")
    assert sorted(tuple(r) for r in H.duplicate_blocks(df).collect()) == [(1, 3, 1), (2, 2, 1)]


# ---- p3 ----
@pytest.mark.parametrize("seed,n_words", [(1, None), (2, 1), (3, 2), (4, 64)])
def test_seen_keys(spark, seed, n_words):
    r = random.Random(seed)
    known = [f"k{r.randint(0, 400)}" for _ in range(150)] + [None]
    batch = [(i, r.choice([None, "hot", "hot", *[f"k{r.randint(0, 800)}" for _ in range(5)]])) for i in r.sample(range(5000), 600)]
    want, have = set(), {k for k in known if k}
    for i, k in sorted(batch):
        if k is not None:
            if k in have:
                want.add(i)
            have.add(k)
    seen, verdicts = S.SeenKeys(spark, spark.createDataFrame([(k,) for k in known], "key string"), n_words=n_words).check(spark.createDataFrame(batch, "record_id bigint, key string"))
    got = [x[0] for x in seen.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    rep = {(x.filter_said, x.truth): x["keys"] for x in S.error_report(verdicts).collect()}
    keys = {k for _, k in batch if k is not None}
    assert ("no", "known") not in rep and sum(rep.values()) == len(keys)
    assert rep.get(("maybe", "known"), 0) == len(keys & {k for k in known if k})


def test_seen_keys_grow(spark):
    frame = lambda ks: spark.createDataFrame(list(enumerate(ks)), "record_id bigint, key string")
    s = S.SeenKeys(spark, frame(["a", "b"]).select("key"), n_words=64)
    one = frame(["a", "c", None, "c"])
    assert sorted(r[0] for r in s.check(one)[0].collect()) == [0, 3]
    s.add(one.select("key"))
    s.add(frame(["z"]).select("key"))
    assert sorted(r[0] for r in s.check(frame(["c", "d", "z", "b"]))[0].collect()) == [0, 2, 3]


def test_seen_keys_reads_what_a_batch_needs(spark):
    """Of 20,000 keys, a batch with 1 % known ones reads less than a tenth; a batch of new keys reads about its false positives."""
    s = S.SeenKeys(spark, spark.range(20000).selectExpr("concat('k', id) as key"))
    ids = spark.range(200)
    known = ids.selectExpr("id as record_id", "case when id < 20 then concat('k', id * 997) else concat('n', id) end as key")
    assert sorted(r[0] for r in s.check(known)[0].collect()) == list(range(20))
    assert 0 < sum(N.within(s.keys, r).count() for r in s.asked) < 2000


def test_seen_keys_empty(spark):
    none = spark.createDataFrame([], "key string")
    batch = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "record_id bigint, key string")
    assert [r[0] for r in S.SeenKeys(spark, none).check(batch)[0].collect()] == [2]
    assert S.SeenKeys(spark, batch.select("key")).check(batch.limit(0))[0].count() == 0


# ---- p5 ----
def check_packing(rows, items, cap):
    """Containers within the capacity, every byte of every item once, only large items split."""
    fill, pieces = {}, {}
    for r in rows:
        assert 1 <= r.piece_bytes <= cap
        fill[r.container] = fill.get(r.container, 0) + r.piece_bytes
        pieces.setdefault((r.k, r["size"]), []).append((r.piece_offset, r.piece_bytes))
    assert all(v <= cap for v in fill.values())
    assert set(pieces) == {(k, s) for k, s in items if s and s > 0}
    for (_, s), ps in pieces.items():
        ps.sort()
        assert [o for o, _ in ps] == [sum(b for _, b in ps[:i]) for i in range(len(ps))] and sum(b for _, b in ps) == s
        assert len(ps) == -(-s // cap)
    return len(fill), sum(fill.values())


@pytest.mark.parametrize("lanes", [1, 4])
def test_packing(spark, lanes):
    r = random.Random(7)
    items = [(f"i{i}", r.choice([r.randint(1, 999), r.randint(1, 50), 1000, 2000, r.randint(1001, 5000), None, 0, -4])) for i in range(4000)]
    df = spark.createDataFrame(items + items[:50], "k string, s int").withColumn("container", F.lit("clash"))
    out = P.pack(df, ["k"], "s", 1000, lane_items=len(items) // lanes + 60, levels=100).collect()
    n, used = check_packing(out, items, 1000)
    assert n <= used / 1000 * 1.02 + 10 * lanes
    again = P.pack(df.repartition(9), ["k"], "s", 1000, lane_items=len(items) // lanes + 60, levels=100).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    assert P.pack(df.limit(0), ["k"], "s", 1000).count() == 0
    rep = P.fill_report(P.pack(df, ["k"], "s", 1000, levels=100), 1000).first()
    assert rep.used_bytes == used and rep.fullest == 1000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.integers(1, 64))
def test_sum_of_squares_rule(sizes, levels):
    """The array always equals the open containers below the top level, and no container overflows."""
    ss, fill = P.SumOfSquares(60, levels), {}
    for s in sizes:
        b = ss.place(s)
        fill[b] = fill.get(b, 0) + s
        count = [0] * (ss.levels + 1)
        for v in fill.values():
            if v < 60 and ss.level(v) < ss.levels:
                count[ss.level(v)] += 1
        assert max(fill.values()) <= 60 and ss.count.tolist() == count
    assert sorted(fill) == list(range(ss.made))


# ---- p7 ----
PASSAGE = "“Vezen counted cabinets,” Dunña wrote, “yet 31,609 crates near Soldendra’s foundry stayed sealed with wax.” At Hopellden granary mossy barrels hung over 152 stencils, priceless since Torpell traded amber tablets. Around market day Nyñalis the surveyor sorted 2,856 eastern keys & borrowed 668 stamps."
NOISE = "The retention job releases all pending replicas and forwards an explicit error code after the last page was read at the configured limit. "
DRESSES = {
    "plain": lambda t: t,
    "upper": str.upper,
    "bare": lambda t: " ".join(L.words(t)),
    "accents": lambda t: unicodedata.normalize("NFD", t),
    "no_accents": lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)),
    "wrapped": lambda t: t.replace(" ", "\n", 9).replace("\n", "\r\n"),
    "quoted": lambda t: "\n".join("> " + " ".join(t.split()[i : i + 7]) for i in range(0, 99, 7)),
    "hyphens": lambda t: t.replace("counted", "coun-\nted").replace("foundry", "foun-\n> dry").replace("priceless", "price­less"),
    "markup": lambda t: "<p>" + html.escape(t).replace("sealed", "<b>sealed</b>").replace(" hung", "<br/>hung") + "</p>",
    "links": lambda t: t.replace("mossy", "[mossy](https://example.org/a-b?c=d#e)").replace("amber", '<a class="x y" href="https://example.org/z">am<i>ber</i></a>'),
    "emphasis": lambda t: t.replace("mossy", "**mossy**").replace("amber", "_amber_"),
    "json": lambda t: '{"text": "' + t.encode("ascii", "backslashreplace").decode().replace("\\xf1", "\\u00f1").replace("\\x", "\\u00") + '"}',
    "mojibake": lambda t: t.encode("utf-8").decode("cp1252", "replace"),
    "zero_width": lambda t: t.replace("e", "e​"),
    "entities": lambda t: t.encode("ascii", "xmlcharrefreplace").decode(),
    "spaces": lambda t: t.replace(" ", "  "),
}


@pytest.fixture(scope="module")
def items():
    other = "263 wooden stamps reached Torña harbour by noon, 35,106 fewer than Dunrithgor the courier buried. Because sleds from Wennortun were infested, Lorithden borrowed 13,326 tilted tablets (about 193 per clerk)."
    return L.Items([(1, PASSAGE), (2, other), (3, PASSAGE.lower()), (4, None), (5, ""), (6, "too short")])


@pytest.mark.parametrize("dress", sorted(DRESSES))
def test_leaks_in_any_dress(items, dress):
    assert sorted(items.leaks(NOISE * 3 + DRESSES[dress](PASSAGE) + "\n" + NOISE)) == [1, 3]
    part = " ".join(PASSAGE.split()[5:27])
    assert sorted(items.leaks(NOISE + DRESSES[dress](part) + " " + NOISE)) == [1, 3]


def test_not_leaks(items):
    w = PASSAGE.split()
    r = random.Random(1)
    shuffled = w[:]
    r.shuffle(shuffled)
    third = [x if i % 3 else "cabinets" for i, x in enumerate(w)]
    for t in ("", NOISE * 50, " ".join(w[:15]), " ".join(w[3:19]), " ".join(shuffled), " ".join(third), " ".join(reversed(w)), "How many crates are named?"):
        assert items.leaks(t) == []


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 25), st.integers(20, 45), st.randoms(use_true_random=False))
def test_one_word_in_ten(items, start, n, r):
    """Any 20 or more consecutive words with an edit in ten at most are found, wherever the edits are."""
    w = PASSAGE.replace("& ", "").split()
    part = w[start : start + n]
    if len(part) < 20:
        return
    out = list(part)
    for k in sorted(r.sample(range(1, len(part) - 1), len(part) // 10), reverse=True):
        out[k : k + 1] = r.choice([["mystery"], [], [out[k], "mystery"]])
    assert items.leaks(NOISE + " ".join(out) + " " + NOISE) == [1, 3]


@pytest.mark.parametrize("place", [0, 1, 10, -2, -1])
@pytest.mark.parametrize("edit", ["replaced", "dropped", "added"])
def test_edits_at_the_edges(items, place, edit):
    """Twenty words with an edit at an edge, and whole passages of 10 to 19 words with one anywhere."""
    w = L.words(PASSAGE)

    def edited(part, k):
        k = range(len(part))[k]
        return part[:k] + {"replaced": ["mystery"], "dropped": [], "added": [part[k], "mystery"]}[edit] + part[k + 1 :]

    assert items.leaks(NOISE + " ".join(edited(w[7:27], place)) + " " + NOISE) == [1, 3]
    for n in (10, 11, 12, 19):
        for k in {min(place, n - 1), n // 2, (n - 1) // 2}:
            assert L.Items([(5, " ".join(w[:n]))]).leaks(NOISE + " ".join(edited(w[:n], k)) + " " + NOISE) == [5]


def test_passages_below_a_window():
    its = L.Items([(n, " ".join(L.words(PASSAGE)[20 : 20 + n])) for n in range(1, 10)])
    w = L.words(PASSAGE)[20:29]
    for n in range(1, 10):
        assert its.leaks(NOISE + " ".join(w[:n]) + " " + NOISE) == list(range(1, n + 1))
    assert its.leaks(" ".join(w[:2])) == [1, 2] and its.leaks(" ".join([w[0], "mystery", *w[2:]])) == [1] and its.leaks(NOISE) == []


def test_passages_of_many_equal_words():
    """Over 60 runs of equal words, most of them of one word."""
    r = random.Random(4)
    w = [x for i in range(80) for x in (f"word{i}", r.choice(["and", "or"]))]
    out = list(w)
    for k in range(6, 150, 10):
        out[k] = "mystery"
    it = L.Items([(1, " ".join(w))])
    assert it.leaks(NOISE + " ".join(out) + " " + NOISE) == [1]
    # one edit between any two words of the item: long, but no part of it has one in ten at most
    assert it.leaks(NOISE + " ".join(x for i, y in enumerate(w) for x in ([y, "mystery"] if i % 6 == 5 else [y]))) == []


def test_edit_alignment_is_exact():
    """The reach for each number of edits against a full table of edit distances."""
    r = np.random.default_rng(5)
    for _ in range(300):
        item, doc = (r.integers(0, 3, r.integers(0, 15)).tolist() for _ in range(2))
        d = np.add.outer(np.arange(len(item) + 1), np.arange(len(doc) + 1))
        for i in range(1, len(item) + 1):
            for j in range(1, len(doc) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (item[i - 1] != doc[j - 1]))
        assert L._reach(item, doc) == [max(i for i in range(len(item) + 1) if d[i].min() <= e) for e in range(L.EDITS + 1)]


def test_search_is_complete():
    """Multi-index search against all pairs of fingerprints."""
    r = np.random.default_rng(3)
    it = L.Items([(i, " ".join(f"w{r.integers(0, 300)}" for _ in range(60))) for i in range(20)])
    near = it.print[r.integers(0, len(it.print), 400)].copy()
    for _ in range(4):
        near ^= np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64)
    q = np.concatenate([near, r.integers(0, 2**63, 200, dtype=np.uint64)])
    x, y = it.near(q)
    d = np.bitwise_count(q[:, None] ^ it.print[None, :])
    assert set(zip(x.tolist(), y.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(d <= L.RADIUS))))


def test_leaks_behind_long_tags_and_links():
    """Tags and link targets of any length inside a passage are taken off."""
    words = [f"w{i}x" for i in range(40)]
    known = L.Items([(1, " ".join(words))])
    for n in (100, 310, 5000):
        tagged = " ".join(f'<a href="https://host/{"q" * n}">{w}</a>' if i % 5 == 2 else f"[{w}](https://host/{'r' * n})" if i % 5 == 4 else w for i, w in enumerate(words))
        assert known.leaks(f"some text before {tagged} and after") == [1]


def test_leaks_in_long_texts(monkeypatch):
    """Documents are fingerprinted in stretches: a passage across the border of two is found."""
    monkeypatch.setattr(L, "STRETCH", 64)
    words = [f"w{i}x" for i in range(30)]
    known = L.Items([(1, " ".join(words))])
    for before in range(30, 70, 3):
        part = words[:9] + ["new"] + words[10:24]
        assert known.leaks(" ".join(["other"] * before + part + ["more"] * 200)) == [1]


def test_leaks_frame(spark, monkeypatch):
    docs = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, NOISE), (5, NOISE * 2000 + PASSAGE)], "doc_id bigint, text string").withColumn("item_id", F.lit(9))
    its = spark.createDataFrame([(7, PASSAGE, "s"), (8, PASSAGE, "s"), (9, None, "s"), (10, NOISE.upper(), "s")], "item_id bigint, passage string, suite string")
    want = [(1, 7), (1, 8), (4, 10), (5, 7), (5, 8), (5, 10)]
    assert sorted(tuple(r) for r in L.leaks(docs, its).collect()) == want
    monkeypatch.setattr(L, "ITEMS_PER_PASS", 1)
    found = L.leaks(docs, its)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert sorted((r.item_id, r.n_documents) for r in L.leak_report(found, its).collect()) == [(7, 2), (8, 2), (9, 0), (10, 2)]
    assert L.leaks(docs, its.limit(0)).count() == L.leaks(docs.limit(0), its).count() == 0


# ---- p8 ----
def test_token_counts_are_exact():
    with open(X.TOKENIZER, "rb") as f:
        n = X._Lengths(f.read())
    for t in ("a", "a b", " a  b ", "x\ny\tz", "Grüße, 東京 ✓", "  ", "▁ ▁▁", "word " * 50 + "end", "1,234.5 e.g. (x)"):
        assert X.count_tokens(t, n) == len(n.sp.encode(t)), t


def mix_input(spark, n=3000):
    r = random.Random(2)
    docs = []
    for i in range(n):
        s = r.choices(["web", "Web", "w-e b", "books", "code", "none", None], [40, 5, 5, 20, 6, 5, 3])[0]
        docs.append((i, s, r.choice(["", None]) if r.random() < 0.02 else f"text {r.randint(0, n) if r.random() < 0.5 else i} " + "word " * r.randint(1, 80)))
    targets = [("web", 0.5, 1), ("books", 0.2, 3), ("Code", 0.2, 5), ("missing", 0.1, 2)]
    return spark.createDataFrame(docs, "doc_id bigint, source string, text string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


@pytest.mark.parametrize("total,damping", [(None, 0.5), (60_000, 0.0), (100_000, 1.0)])
def test_mix(spark, total, damping):
    docs, targets = mix_input(spark)
    drawn, report = X.mix(docs, targets, total, damping)
    text = {r.doc_id: r.text for r in docs.collect()}
    got = drawn.collect()
    limit = {"web": 1, "books": 3, "Code": 5}
    assert len({text[r.doc_id] for r in got}) == len(got) and all(1 <= r.copies <= limit[r.source] for r in got)
    rep = {r.source: r for r in report.collect()}
    assert set(rep) == {"web", "books", "Code", "missing"} and rep["missing"].tokens_drawn == 0
    for s in limit:
        assert abs(rep[s].actual_share - rep[s].attainable_share) < 0.004
        assert rep[s].tokens_drawn == sum(r.copies * r.tokens for r in got if r.source == s)
    if total:
        assert abs(sum(r.tokens_drawn for r in rep.values()) - total) < 300
    assert sorted(map(tuple, X.mix(docs.repartition(7), targets, total, damping)[0].collect())) == sorted(map(tuple, got))


def test_mix_is_pareto(spark):
    """The extra copies are those of least odds: brute force of the ranks of one source."""
    docs, targets = mix_input(spark, 800)
    drawn, _ = X.mix(docs, targets.where("source = 'books'"), 5000, 0.0)
    one = X.token_counts(docs).groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("u")).select("u.*").where("source = 'books'")
    one = one.withColumn("odd", F.pmod(F.xxhash64("doc_id", F.lit(X.SEED)), F.lit(1 << 52))).orderBy("odd").collect()
    want, t = set(), 0
    for r in one:
        if t + r.tokens / 2 > 5000:
            break
        want.add(r.doc_id)
        t += r.tokens
    assert {r.doc_id for r in drawn.collect()} == want


def test_mix_sorts_little(spark, monkeypatch):
    """The source that binds the total isn't ranked at all; of the others only a bin of a bin is sorted, and how many bins there are
    doesn't change what is drawn."""
    docs, targets = mix_input(spark, 2000)
    seen, written = {}, X.written
    monkeypatch.setattr(X, "written", lambda df, name: seen.setdefault(name, written(df, name)))
    drawn = sorted(map(tuple, X.mix(docs, targets)[0].collect()))
    ranked = seen["ranked"].where("odds > 0").groupBy("source", "bin", "bin2").count().collect()
    assert len({r.source for r in ranked}) == 2  # three sources have texts, one binds
    assert max(r["count"] for r in ranked) <= 3  # certain texts (odds 0) lie below any cut
    seen.clear()
    monkeypatch.setattr(X, "BINS", 4)
    assert sorted(map(tuple, X.mix(docs, targets)[0].collect())) == drawn


def test_mix_empty(spark):
    docs, targets = mix_input(spark, 50)
    d, r = X.mix(docs.limit(0), targets)
    assert d.count() == 0 and r.count() == 4 and r.agg(F.sum("tokens_drawn")).first()[0] == 0
    d, r = X.mix(docs, targets.limit(0))
    assert d.count() == r.count() == 0


# ---- p9 ----
def test_running_text():
    t = "# Title\n\nThe disk check reads the whole file. It works; then it stops for a while!\n```\nval x = the and of to\n```\n    the code of a block here now\n| the | of | and | to |\n$ casctl the of and to\n2024-01-01T00:00:00Z level=INFO op=get key=a b=c d=e f=g\n3. And the last line ends here"
    assert R.sentences(t) == [
        "the disk check reads the whole file".split(),
        "then it stops for a while".split(),
        "and the last line ends here".split(),
    ]


@pytest.mark.parametrize("width", [60, 72, 100])
@pytest.mark.parametrize("mark", ["", "> "])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_text_has_its_sentences(width, mark, end):
    """Hard-wrapped prose gives the sentences of the same text on one line; short lines and list lines stay apart."""
    import textwrap

    one = "notwithstanding the obligations which the preceding section imposes upon the custodian of the archive, every determination concerning the retention of duplicated material shall be communicated to the depositor within a reasonable period"
    text = " ".join(f"{x}, {one}." for x in ("Furthermore", "Consequently", "Nevertheless"))
    wrapped = end.join(mark + x for x in textwrap.wrap(text, width, break_on_hyphens=False))
    assert R.sentences(wrapped) == R.sentences(text) and len(R.sentences(text)) == 3
    assert R.sentences(f"{wrapped}{end}{end}{wrapped}") == 2 * R.sentences(text)
    listed = ["op_1: the server reads the whole file once a week without any stop", "op_2: the queue is full", "op_3: the last disk is ready for the next page of the list"]
    assert R.sentences(end.join(listed)) == [x for y in listed for x in R.sentences(y)]
    short = ["copy the file first", "close all of the pages", "then open the list"]
    assert R.sentences(end.join(short)) == [x.split() for x in short]


def test_coverage_ranks_beyond_the_vocabulary(spark):
    """Documents of rare words get their rank by joins: brute force over all words, ties beyond the vocabulary share a rank."""
    docs = spark.read.parquet(f"{DATA}/{SF}/documents.parquet")
    got = {r.doc_id: r for r in R.measures(docs, vocabulary=40).collect()}
    texts = {i: ss for i, t in docs.select("doc_id", "text").where("text is not null").collect() if sum(map(len, ss := R.sentences(t))) >= R.MIN_WORDS and R._is_english(ss)}
    n = Counter(w for ss in texts.values() for s in ss for w in s)
    assert set(got) == set(texts)
    floor = R._least_count(spark.createDataFrame(list(n.items()), "text string, n bigint"), 40)
    assert sum(k > floor for k in n.values()) <= 40 < sum(k >= floor for k in n.values())
    top = {w: k + 1 for k, w in enumerate(sorted((w for w in n if n[w] > floor), key=lambda w: (-n[w], w)))}
    least = Counter(n.values())
    rank = {w: top.get(w) or sum(c for k, c in least.items() if k >= n[w]) for w in n}
    for i, ss in texts.items():
        r = sorted(rank[w] for s in ss for w in s)
        assert got[i].coverage_rank == r[int(np.ceil(0.5 * len(r))) - 1]
    assert any(x.coverage_rank > len(top) for x in got.values()) and any(x.coverage_rank <= len(top) for x in got.values())


def test_levels_held_out(spark):
    """Grades of half the labelled documents against a calibration on the other half."""
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "level_labels"))
    half = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r.level for r in R.levels(docs, half).collect()}
    grades = {}
    for r in labels.where("doc_id % 2 = 1 and grade is not null").collect():
        grades.setdefault(r.doc_id, []).append(r.grade)
    held = [(got[k] >= 4, np.mean(g) >= 3.5, abs(got[k] - np.mean(g)) <= 1) for k, g in grades.items()]
    assert len(held) > 300
    assert np.mean([a == b for a, b, _ in held]) > 0.94 and np.mean([c for _, _, c in held]) > 0.97


def test_levels_edges(spark):
    text = "The cat sat on the mat and it was a happy cat. " * 5
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "der die das und ist nicht " * 9), (5, "| a | b |\n" * 9), (6, text * 400)], "doc_id bigint, text string").withColumn("level", F.lit(7))
    labels = spark.createDataFrame([(1, 2), (1, None), (None, 3)], "doc_id bigint, grade int")
    got = {r.doc_id: r.level for r in R.levels(docs, labels).collect()}
    assert got == {1: 2, 6: 2}
    assert {r.level for r in R.levels(docs, labels.limit(0)).collect()} == {3}
    assert R.levels(docs.limit(0), labels).count() == 0
    assert R.profile(R.levels(docs, labels)).first().documents == 2
