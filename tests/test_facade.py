"""The whole-object store end to end."""

import random

import pytest
from pyspark.sql import functions as F

from blockloom.operators import transduce as X
from blockloom.store import BlobStore


@pytest.mark.parametrize("cdc", [None, (64, 256, 1024)])
def test_blob_store(spark, tmp_path, cdc):
    r = random.Random(3)
    a = r.randbytes(5000)
    data = {"a": a, "copy": a, "moved": a[:900] + b"inserted" + a[900:], "one": b"x", "none": b""}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "name string, data binary")
    s = BlobStore(spark, str(tmp_path / "store"), 256, cdc)
    assert s.stat().count() == 0
    out = {x.name: x for x in s.put(df).collect()}
    assert set(out) == {"a", "copy", "moved", "one"} and out["a"].blob_key == out["copy"].blob_key
    assert all(x.block_count == x.fresh_blocks + x.duplicate_blocks for x in out.values())
    if cdc:
        assert out["a"].duplicate_blocks + out["moved"].duplicate_blocks > 8
    keys = spark.createDataFrame([(x.blob_key,) for x in out.values()], "blob_key string")
    assert {bytes(x.data) for x in s.get(keys).collect()} == set(data.values()) - {b""}
    assert all(x.ok for x in s.verify(keys).collect())
    assert {x.size for x in s.stat().collect()} == {5000, 5008, 1}
    again = s.put(df.where("name = 'a'")).first()
    assert again.fresh_blocks == 0 and again.dedup_ratio == 1.0
    s.delete(keys.where(F.col("blob_key") == out["one"].blob_key))
    assert s.stat().count() == 2 and s.get(keys).count() == 2
    s.put(df.where("name = 'one'"))
    assert s.stat().count() == 3
    n = s.stats().first()
    assert n.total_bytes == 10009 and n.unique_blocks == s.folder.blocks().count()
    upper = s.put(spark.createDataFrame([("t", bytearray(b"abc"))], "name string, data binary"), program=lambda d: d.withColumn("data", F.encode(F.upper(F.decode("data", "UTF-8")), "UTF-8")))
    k = upper.select("blob_key")
    assert bytes(s.get(k).first().data) == b"ABC"


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.txt").write_bytes(b"hello" * 100)
    s = BlobStore(spark, str(tmp_path / "store"), 64)
    assert s.put_files(str(tmp_path / "in")).first().total_bytes == 500


def test_observed_and_folds(spark):
    d = spark.createDataFrame([("s", i, v) for i, v in enumerate([b"ab", b"", None, b"c"])], "k string, i int, v binary")
    out, o = X.observed(d, "pass", F.octet_length("v"))
    assert out.count() == 4 and o.get == {"rows": 4, "bytes": 3}
    import hashlib

    assert X.hash_stream(d, ["k"], ["i"], "v").first()[1:] == (hashlib.sha256(b"abc").hexdigest(), 3)
    blocks, summary = X.count_hash_rechunk(d, ["k"], ["i"], "v", 2)
    assert [bytes(r.block) for r in blocks.orderBy("block_index").collect()] == [b"ab", b"c"] and summary.first().bytes == 3

    def pairs(rows):
        held = None
        for (v,) in rows:
            if held is not None:
                yield (f"{held}-{v}",)
            held = v
        yield (f"end {held}",)

    e = X.fold_emit(d.drop("v").withColumn("v", F.col("i")), ["k"], ["i"], ["v"], "o string", pairs)
    assert sorted(r.o for r in e.collect()) == ["0-1", "1-2", "2-3", "end 3"]
