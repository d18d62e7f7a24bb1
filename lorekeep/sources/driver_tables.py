"""The driver's tables as the canonical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("conv_ord"), F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("int").alias("msg_ord"), F.concat_ws("-", "conv_id", "turn").alias("id"), "role", F.col("text").alias("content"), F.lit(None).cast("double").alias("timestamp"), F.lit(False).alias("is_hidden"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return t.select(F.col("conv_id").alias("conv_ord"), F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("conv "), F.col("conv_id")).alias("title"), F.col("conv_id").cast("double").alias("create_time"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as facts: text, source as category, doc_id as time and order."""
    t = table(spark, sf_dir, "documents")
    return t.select(F.col("doc_id").alias("fact_ord"), F.col("text").alias("fact"), F.col("source").alias("category"), F.col("doc_id").cast("string").alias("source_convo_id"), F.col("doc_id").cast("double").alias("source_timestamp"), F.substring("text", 1, 60).alias("source_quote"))
