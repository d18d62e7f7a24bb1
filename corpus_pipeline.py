"""A training corpus from `documents`: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import decontaminate, linededup, mixing, nearcopies, toxicity
from lorekeep.llm.common import release, settled, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger rejects go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier one go; documents stay, and n_chars follows the text."""
    return linededup.clean(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash links, verified, and what these miss; five-word shingles, Jaccard 0.8."""
    return nearcopies.dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in the mixture of sources."""
    return mixing.mix(docs)


STAGES = [("toxicity", toxic), ("line_dedup", repeated_lines), ("near_dedup", near_copies), ("decontamination", benchmark_leaks), ("mixing", mixed)]
#: Trained scores, similarity joins and deadlines are not SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
