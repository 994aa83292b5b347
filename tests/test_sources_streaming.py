"""Readers, the block folder, legacy catalogues and streaming state across restarts."""

import os
import random

from pyspark.sql import functions as F

from blockloom.operators import store
from blockloom.plans.streaming_queries import streaming_windows
from blockloom.sources import tables as T
from blockloom.streaming import ingest


def test_files_and_folder(spark, tmp_path, rows):
    data = {f"f{i}.bin": random.Random(i).randbytes(5000) for i in range(3)}
    data["copy.bin"] = data["f0.bin"]
    (tmp_path / "in").mkdir()
    for n, b in data.items():
        (tmp_path / "in" / n).write_bytes(b)
    chunks = T.file_chunks(spark, str(tmp_path / "in"), 1024, "*.bin")
    assert chunks.count() == 20
    blocks = store.keyed_blocks(chunks)
    folder = T.BlockFolder(spark, str(tmp_path / "store"))
    first = folder.put(blocks, ["path", "block_index"])
    assert first.groupBy("status").count().orderBy("status").collect() == [("Duplicate", 5), ("Fresh", 15)]
    assert folder.put(blocks, ["path", "block_index"], forward=True).where("status = 'Forwarded'").count() == 20
    assert folder.blocks().count() == 15
    assert folder.get(blocks.where("block_index = 0")).count() == 3
    back = store.read_back(store.build_manifest(blocks, "path", ["block_index"]), folder.blocks(), "path")
    assert {r.path.rsplit("/", 1)[1]: bytes(r.data) for r in back.collect()} == data


def test_legacy(spark, rows):
    docs = spark.createDataFrame([("a.xml", "<d><Title> One </Title><hash>AB12</hash></d>"), ("b.xml", "<d><x:title lang='e'>Two</x:title><hash>ffee</hash></d>"), ("c.xml", None)], "path string, text string")
    d = T.legacy_documents(docs, {"title": T.xml_element("title"), "hash": T.xml_element("hash")})
    assert rows(d.select("path", "title", "hash")) == [("a.xml", "One", "AB12"), ("b.xml", "Two", "ffee"), ("c.xml", None, None)]
    present = spark.createDataFrame([("root/ab/12/ab12",), ("root/ab12",), ("elsewhere/ffee",)], "path string")
    r = T.resolve_paths(d, "hash", present, "root")
    assert {x.path: x.binary_path for x in r.collect()} == {"a.xml": "root/ab/12/ab12", "b.xml": "elsewhere/ffee", "c.xml": None}


def test_state_outlives_a_restart(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    read = lambda: ingest.running_totals(ingest.read_files(spark, src, "k string, n bigint"), "k", "n")
    spark.createDataFrame([("a", 1), ("a", None), ("b", 5)], "k string, n bigint").coalesce(1).write.parquet(src)
    ingest.run_once(read(), out, cp, "update")
    spark.createDataFrame([("a", 10)], "k string, n bigint").coalesce(1).write.mode("append").parquet(src)
    got = ingest.run_once(read(), out, cp, "update")
    last = {}
    for r in got.orderBy("trigger").collect():
        last[r.k] = (r["count"], r.bytes)
    assert last == {"a": (3, 11), "b": (1, 5)}


def test_first_seen_over_triggers(spark, tmp_path):
    src = str(tmp_path / "src")
    for i in range(3):
        spark.createDataFrame([("x", i), (f"y{i}", i)], "k string, i int").coalesce(1).write.mode("append").parquet(src)
    s = ingest.first_seen(ingest.read_files(spark, src, "k string, i int").select("k"), "k")
    assert sorted(r.k for r in ingest.run_once(s, str(tmp_path / "o"), str(tmp_path / "c")).collect()) == ["x", "y0", "y1", "y2"]


def test_tee(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(10).coalesce(1).write.parquet(src)
    seen = [[], []]
    q = ingest.tee(ingest.read_files(spark, src, "id bigint"), [lambda b, e: seen[0].append(b.count()), lambda b, e: seen[1].append(b.agg(F.sum("id")).first()[0])], str(tmp_path / "c"))
    q.awaitTermination()
    assert seen == [[10], [45]]


def test_merge_spans():
    assert ingest.merge_spans([(5, 9), (0, 3), (4, 4), (20, 21)]) == [(0, 9), (20, 21)]


def test_windows_of_parts_in_any_order(spark, tmp_path):
    """A part that is read long after later ones loses no row, however the table is split."""
    days = [29, 30, 1, 28, 2, 15]
    for k, d in enumerate(days):
        rows = spark.createDataFrame([(f"2024-01-{d:02} 10:15:00", "view", 1.0), (f"2024-01-{d:02} 10:45:00", "view", 2.0)], "t string, event_type string, value double")
        rows.select(F.col("t").cast("timestamp_ntz").alias("ts"), "event_type", "value").coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
    (tmp_path / "sf" / "events.parquet").mkdir(parents=True)
    for k in range(len(days)):
        (part,) = (tmp_path / f"p{k}").glob("part-*.parquet")
        to = tmp_path / "sf" / "events.parquet" / f"part-{k}.parquet"
        part.rename(to)
        os.utime(to, (1_700_000_000 + 60 * k,) * 2)
    got = {(r.window_start.day, r.window_start.hour): r.n for r in streaming_windows(spark, str(tmp_path / "sf")).collect()}
    assert got == {(d, 10): 2 for d in days}
