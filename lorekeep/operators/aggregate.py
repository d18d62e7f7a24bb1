"""Exact aggregation of equal facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import normalize_text


def aggregate_facts(facts: DataFrame) -> DataFrame:
    """Facts that read alike when normalised become one: the newest, the first of equally new ones.

    Gives frequency, the range of times, and first_ord, by which groups keep the order in which they were first seen.
    The category is that of the chosen fact. One shuffle on the normalised text, after partial aggregation.
    """
    row = F.struct(*[c for c in ("fact", "category", "source_convo_id", "source_timestamp", "source_quote") if c in facts.columns])
    newest = F.struct(F.col("source_timestamp"), -F.col("fact_ord"))
    grouped = facts.groupBy(normalize_text("fact").alias("norm")).agg(F.max_by(row, newest).alias("r"), F.count("*").alias("frequency"), F.min("source_timestamp").alias("min_timestamp"), F.max("source_timestamp").alias("max_timestamp"), F.min("fact_ord").alias("first_ord"))
    return grouped.select("norm", "r.*", "frequency", "min_timestamp", "max_timestamp", "first_ord")


def group_by_category(aggregated: DataFrame) -> DataFrame:
    """(category, category_ord, facts): categories in the order in which they were first seen."""
    return aggregated.groupBy("category").agg(F.min("first_ord").alias("category_ord"), F.array_sort(F.collect_list(F.struct("first_ord", "fact", "frequency"))).alias("facts"))
