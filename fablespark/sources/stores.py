"""Reading and writing domain tables, uploads, manifests and object storage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fablespark.sources.schema import TABLES


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A domain table with its declared schema; nothing is inferred."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def append(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("append").parquet(f"{folder}/{name}")


def replace_partitions(df: DataFrame, folder: str, name: str, key: str = "book_id", covers: list | None = None) -> None:
    """Rewrite just the partitions that ``df`` holds: running a stage twice changes nothing.

    ``covers`` names all keys (books) that the run is about: the partition of
    one that now has no rows is taken away, so that nothing stale stays.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{folder}/{name}")
    if covers:
        held = {r[0] for r in df.filter(F.col(key).isin(*covers)).select(key).distinct().collect()}  # keys of one run
        store = ObjectStore(df.sparkSession, f"{folder}/{name}")
        for k in covers:
            if k not in held:
                store.delete_prefix(f"{key}={df.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(k))}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], guard: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of equal key; rows of ``old`` that the guard column marks stay as they are."""
    if guard is not None:
        held = old.filter(F.coalesce(F.col(guard), F.lit(False))).select(*keys)
        new = new.join(held, keys, "left_anti")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def with_content_hash(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256))


def new_uploads(incoming: DataFrame, existing: DataFrame, scope: str = "project_id") -> DataFrame:
    """Uploads whose content the project does not hold yet, one row for each content (the least id)."""
    first = incoming.groupBy(scope, "content_hash").agg(F.min("id").alias("id"))
    return incoming.join(first, [scope, "content_hash", "id"]).join(existing.select(scope, "content_hash").distinct(), [scope, "content_hash"], "left_anti")


def checked_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files joined to a manifest (name, sha256, series_order); a mismatch or a missing file fails the job."""
    joined = manifest.join(files, "name", "left")
    ok = F.coalesce(F.col("content_hash") == F.col("sha256"), F.lit(False))
    return joined.withColumn("sha256", F.when(ok, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("checksum mismatch: "), F.col("name")))))


def load_documents(spark: SparkSession, path: str, parser: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Binary files parsed on the executors; ``parser`` gives a file's items as dicts of ``schema``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"path": p} | item for p, content in zip(f["path"], f["content"], strict=True) for item in parser(content)]
            yield pd.DataFrame(rows, columns=["path", *[c.split()[0] for c in schema.split(",")]])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {schema}")


class ObjectStore:
    """Keys under a root that Hadoop's file systems reach; no local paths."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")

    def _at(self, key: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
        return path.getFileSystem(self._conf), path

    def put(self, key: str, content: bytes) -> None:
        fs, path = self._at(key)
        out = fs.create(path, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def get(self, key: str) -> bytes:
        fs, path = self._at(key)
        stream = fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, key: str) -> bool:
        fs, path = self._at(key)
        return fs.exists(path)

    def delete_prefix(self, prefix: str) -> bool:
        fs, path = self._at(prefix)
        return fs.delete(path, True)


def checksum(df: DataFrame) -> DataFrame:
    """(n, checksum): the same for the same rows in any order; a sum beside the xor, in which equal rows would cancel out."""
    sums = F.concat_ws(":", F.bit_xor("h").cast("string"), F.sum(F.col("h").cast("decimal(20,0)")).cast("string"))
    return df.select(F.xxhash64(*sorted(df.columns)).alias("h")).agg(F.count("*").alias("n"), sums.alias("checksum"))
