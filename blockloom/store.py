"""One object to keep and read whole objects by content: blocks and manifests as Parquet in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import digests as D
from blockloom.operators import catalog, chunking, store
from blockloom.sources.tables import BlockFolder, files
from blockloom.workspace import written

MANIFEST = "blob_key string, ordinal bigint, block_key string, start bigint, end bigint, ingested_at timestamp"


class BlobStore:
    """Objects (name, data) in, by their key ``sha-256:<digest>:<bytes>`` out.

    Equal objects are stored once, equal blocks of different objects too. Writes are appends that appear at the commit of their job;
    a delete appends a mark and leaves the blocks.
    """

    def __init__(self, spark: SparkSession, path: str, block_bytes: int = 1 << 20, cdc: tuple[int, int, int] | None = None):
        self.spark, self.path, self.block_bytes, self.cdc = spark, path.rstrip("/"), block_bytes, cdc
        self.folder = BlockFolder(spark, f"{self.path}/blocks")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def manifests(self) -> DataFrame:
        """The entries of all blobs that aren't deleted; a blob put again after its deletion is there again."""
        gone = self._read("deleted", "blob_key string, deleted_at timestamp").groupBy("blob_key").agg(F.max("deleted_at").alias("deleted_at"))
        m = self._read("manifests", MANIFEST).join(gone, "blob_key", "left")
        return m.where("deleted_at is null or ingested_at > deleted_at").drop("deleted_at").dropDuplicates(["blob_key", "ordinal"])

    def put(self, objects: DataFrame, name: str = "name", data: str = "data", program=lambda d: d) -> DataFrame:
        """(name, blob_key, total_bytes, block_count, fresh_blocks, duplicate_blocks, dedup_ratio). ``program`` transforms the objects
        before anything is hashed. Objects without bytes are refused: they are left out."""
        o = program(objects).where(F.octet_length(data) > 0)
        o = o.withColumn("blob_key", D.block_key_of(F.col(data)))
        first = o.select("blob_key", F.col(data).alias("data")).dropDuplicates(["blob_key"])  # rows of a key are equal
        cut = chunking.cdc_blocks(first, "blob_key", "data", *self.cdc) if self.cdc else chunking.fixed_blocks(first, ["blob_key"], "data", self.block_bytes)
        blocks = written(store.keyed_blocks(cut).select("blob_key", "block_index", "block_key", "size", "block"), "blocks")
        put = self.folder.put(blocks, ["blob_key", "block_index"])
        m = store.build_manifest(blocks, "blob_key", ["block_index"])
        m.withColumn("ingested_at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/manifests")
        return o.select(name, "blob_key").join(store.ingest_stats(put, ["blob_key"]), "blob_key")

    def put_files(self, path: str, glob: str | None = None) -> DataFrame:
        return self.put(files(self.spark, path, glob), "path", "data")

    def get(self, keys: DataFrame) -> DataFrame:
        """(blob_key, missing, data, size) of the keys that exist."""
        m = self.manifests().join(keys.select("blob_key").distinct(), "blob_key", "left_semi")
        return store.read_back(m, self.folder.get(m), "blob_key")

    def stat(self) -> DataFrame:
        """(blob_key, size, blocks, ingested_at)"""
        m = self.manifests()
        return store.stat(m, "blob_key", m.groupBy("blob_key").agg(F.min("ingested_at").alias("ingested_at")))

    def delete(self, keys: DataFrame) -> None:
        keys.select("blob_key").distinct().withColumn("deleted_at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/deleted")

    def verify(self, keys: DataFrame) -> DataFrame:
        """(blob_key, actual, ok): read again, hashed again, block by block."""
        m = self.manifests().join(keys.select("blob_key").distinct(), "blob_key", "left_semi")
        expected = m.select("blob_key").distinct().withColumn("expected", F.split("blob_key", ":")[1])
        return store.verify_stored(m, self.folder.get(m), "blob_key", expected)

    def read(self, keys: DataFrame) -> DataFrame:
        """(blob_key, ordinal, start, data): the blocks of the keys that exist, in order; for blobs of any size."""
        m = self.manifests().join(keys.select("blob_key").distinct(), "blob_key", "left_semi")
        return store.read_rows(m, self.folder.get(m), "blob_key")

    def stats(self) -> DataFrame:
        m = self.manifests().select("block_key", (F.col("end") - F.col("start") + 1).alias("size"))
        return catalog.system_stats(m)
