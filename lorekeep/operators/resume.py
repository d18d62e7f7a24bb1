"""Resumable stages: tables keyed by chunk, under a manifest of what they were made from."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_hash(spark: SparkSession, path: str) -> str:
    """`sha256:<hex>` of a file's bytes."""
    return "sha256:" + spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first().h


def checkpoint_path(folder: str, source: str) -> str:
    """Where the stages of a source are kept: by the first 12 hex digits of its path's hash."""
    return f"{folder}/checkpoint-{hashlib.sha256(source.encode()).hexdigest()[:12]}"


def remaining(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks without a completed row: an anti-join."""
    return chunks.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti")


def completed(results: DataFrame) -> DataFrame:
    """Only chunks that went well count; one that failed is taken up again."""
    return results.filter("status = 'ok'").select("chunk_id").distinct()


class Manifest:
    """What stages were made from: the source's hash and the settings that shape its chunks. Other settings start afresh."""

    def __init__(self, spark: SparkSession, folder: str, source_hash: str, **settings):
        self.spark, self.folder = spark, folder
        self.key = hashlib.sha256(json.dumps([source_hash, settings], sort_keys=True).encode()).hexdigest()[:16]
        self.source_hash = source_hash

    def path(self, stage: str) -> str:
        return f"{self.folder}/{self.key}/{stage}"

    def load(self, stage: str) -> DataFrame | None:
        """The stage's table; None where it is missing or was not finished."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(stage) + "/_SUCCESS")
        return self.spark.read.parquet(self.path(stage)) if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at) else None

    def save(self, stage: str, df: DataFrame) -> DataFrame:
        """Write once; the commit makes it visible whole or not at all."""
        df.write.mode("overwrite").parquet(self.path(stage))
        return self.spark.read.parquet(self.path(stage))

    def stage(self, name: str, make) -> DataFrame:
        """The finished table, or the one that make() gives, written."""
        found = self.load(name)
        return found if found is not None else self.save(name, make())

    def append(self, stage: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("append").parquet(self.path(stage))
        return self.spark.read.parquet(self.path(stage))

    def document(self, done: DataFrame, facts: DataFrame) -> dict:
        """A small account of the state, for people and other tools."""
        return {"source_file_hash": self.source_hash, "completed_chunks": sorted(r.chunk_id for r in done.select("chunk_id").distinct().collect()), "verified_facts": facts.count()}
