"""Readers and writers: files, block folders, JDBC and legacy catalogues.

Object stores are reached through their Hadoop paths (``s3a://...``); nothing here differs for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators import chunking, store


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, modified, data) of whole files; the data column is only read if a query uses it."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("path", "length", F.col("modificationTime").alias("modified"), F.col("content").alias("data"))


def file_chunks(spark: SparkSession, path: str, chunk: int = 65536, glob: str | None = None) -> DataFrame:
    """(path, block_index, block_start, block_end, block): files in chunks."""
    return chunking.fixed_blocks(files(spark, path, glob), ["path"], "data", chunk)


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Parquet, ORC, CSV, JSON or text. Text formats need a schema: it is never guessed by another pass over the data."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    r = spark.read.format(kind).options(**options)
    return (r.schema(schema) if schema else r).load(path)


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, fetch: int = 256, **options: str) -> DataFrame:
    """A relational table, read in ``parts`` ranges of a numeric key where bounds are given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch).options(**options)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


class BlockFolder:
    """Blocks in Parquet, partitioned by the first hex digits of their digest; a key is stored once.

    ``put`` appends only blocks that are new and answers with a status per block. A write is one Spark job whose files appear at its
    commit, so a lost executor leaves no half-written block. Two writers at once may store a key twice; readers take one.
    """

    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        self.spark, self.path, self.digits = spark, path, digits

    def blocks(self) -> DataFrame:
        try:
            return self.spark.read.parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], "block_key string, size bigint, block binary, shard string")

    def put(self, blocks: DataFrame, order: Sequence[str], forward: bool = False) -> DataFrame:
        """``blocks`` (block_key, size, block, order...) with ``status``; with ``forward`` only what was passed on."""
        from blockloom.workspace import written

        out = written(store.put_blocks(blocks, order, self.blocks().select("block_key")), "put")
        fresh = out.where("status = 'Fresh'").select("block_key", "size", "block", F.substring(F.split("block_key", ":")[1], 1, self.digits).alias("shard"))
        fresh.repartition("shard").write.mode("append").partitionBy("shard").parquet(self.path)
        return store.forward_duplicates(out) if forward else out

    def get(self, keys: DataFrame) -> DataFrame:
        """(block_key, size, block) of the keys that are stored; only the shards asked for are read where they are few."""
        return self.blocks().join(keys.select("block_key").distinct(), "block_key", "left_semi").dropDuplicates(["block_key"])


def legacy_documents(files: DataFrame, fields: dict[str, str], text: str = "text") -> DataFrame:
    """``files`` (path, text) of XML metadata with one column per field: the first match of each pattern, null if none; an element's
    text is freed of white space around it."""
    d = files
    for name, pattern in fields.items():
        hit = F.regexp_extract(text, pattern, 1)
        d = d.withColumn(name, F.nullif(F.regexp_replace(hit, r"^\s+|\s+$", ""), F.lit("")))
    return d.drop(text)


def xml_element(name: str) -> str:
    return rf"(?is)<(?:\w+:)?{name}\b[^>]*>(.*?)</(?:\w+:)?{name}>"


def path_candidates(hash_hex: Column, root: str) -> Column:
    """Where a legacy binary may lie, best first: sharded by two levels, by one, flat."""
    h = F.lower(hash_hex)
    a, b = F.substring(h, 1, 2), F.substring(h, 3, 2)
    return F.array(F.concat_ws("/", F.lit(root), a, b, h), F.concat_ws("/", F.lit(root), a, h), F.concat_ws("/", F.lit(root), h))


def resolve_paths(documents: DataFrame, hash_column: str, present: DataFrame, root: str) -> DataFrame:
    """``documents`` with ``binary_path``: the first candidate that exists in ``present`` (path), else any file of that name, else null."""
    d = documents.withColumn("__c", path_candidates(F.col(hash_column), root))
    e = d.select(hash_column, F.posexplode("__c").alias("__i", "path")).distinct().join(present.select("path").distinct(), "path")
    first = e.groupBy(hash_column).agg(F.min(F.struct("__i", "path")).alias("m")).select(hash_column, F.col("m.path").alias("__direct"))
    index = present.groupBy(F.lower(F.substring_index("path", "/", -1)).alias("__name")).agg(F.min("path").alias("__any"))
    j = d.join(first, hash_column, "left").join(index, F.lower(F.col(hash_column)) == F.col("__name"), "left")
    return j.withColumn("binary_path", F.coalesce("__direct", "__any")).drop("__c", "__direct", "__any", "__name")
