"""Writes: vector collections, encrypted metadata, reports."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAR_FIELDS = ("file_path", "start_line", "language", "collection")


class Collections:
    """Vectors as one Parquet table, partitioned by collection."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def insert(self, rows: DataFrame, collection: str) -> None:
        if not re.fullmatch(r"[\w.-]+", collection):
            raise ValueError(f"not a collection name: {collection!r}")
        rows.withColumn("collection", F.lit(collection)).write.mode("append").partitionBy("collection").parquet(self.path)

    def read(self, collection: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        return df if collection is None else df.where(F.col("collection") == collection)  # prunes partitions

    def _folder(self, collection: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/collection={collection}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, collection: str) -> bool:
        path, fs = self._folder(collection)
        return bool(fs.exists(path))

    def drop(self, collection: str) -> None:
        path, fs = self._folder(collection)
        fs.delete(path, True)

    def get(self, collection: str, ids: list[str]) -> DataFrame:
        return self.read(collection).where(F.col("id").isin(ids))

    def delete(self, collection: str, ids: DataFrame) -> None:
        """Rewrite one collection without the ids (id). The new files are whole before the
        old ones go, and both are in the folder of the collection's next generation until
        then: a failure on the way leaves the old rows, or the new ones. A collection of
        which nothing is left stays, empty."""
        rest = self.read(collection).join(ids, "id", "left_anti").drop("collection")
        target, fs = self._folder(collection)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        spare, old = path(f"{self.path}/.{collection}.next"), path(f"{self.path}/.{collection}.old")
        fs.delete(spare, True)
        rest.write.parquet(spare.toString())
        fs.delete(old, True)
        fs.rename(target, old)
        if not fs.rename(spare, target):
            fs.rename(old, target)
            raise OSError(f"the new files of {collection} could not be put in place")
        fs.delete(old, True)

    def recover(self, collection: str) -> None:
        """Put back the old files where a delete ended between its two renames."""
        target, fs = self._folder(collection)
        old = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/.{collection}.old")
        if fs.exists(old) and not fs.exists(target):
            fs.rename(old, target)


def chunk_rows(chunks: DataFrame, embed: Column) -> DataFrame:
    """Chunks with their vector and JSON metadata; lines stay numbers."""
    meta = F.to_json(F.struct("file_path", "start_line", "end_line", "language"))
    return chunks.select("id", embed.alias("vector"), "content", "file_path", "start_line", "language", meta.alias("metadata"))


def encrypt_metadata(df: DataFrame, key: str, column: str = "metadata", clear: tuple[str, ...] = CLEAR_FIELDS) -> DataFrame:
    """AES-GCM of the JSON metadata; some fields stay readable."""
    secret = F.base64(F.aes_encrypt(column, F.lit(key), F.lit("GCM")))
    open_fields = F.to_json(F.struct(*[F.get_json_object(column, f"$.{c}").alias(c) for c in clear]))
    return df.withColumn("encrypted", secret).withColumn(column, open_fields)


def decrypt_metadata(df: DataFrame, key: str, column: str = "metadata") -> DataFrame:
    plain = F.aes_decrypt(F.unbase64("encrypted"), F.lit(key), F.lit("GCM")).cast("string")
    return df.withColumn(column, plain).drop("encrypted")


def annotations(violations: DataFrame) -> DataFrame:
    """CI annotation lines of violations."""
    kind = F.when(F.col("severity") == "ERROR", "error").when(F.col("severity") == "WARNING", "warning").otherwise("notice")
    return violations.select(F.concat(F.lit("::"), kind, F.lit(" file="), "path", F.lit(",line="), "line_no", F.lit("::["), "rule", F.lit("] "), "message").alias("line"))


def report_json(summary: DataFrame) -> str:
    """A report of a summary that has one row for each category."""
    return json.dumps([r.asDict() for r in summary.orderBy("category").collect()])
