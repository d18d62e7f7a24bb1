"""Counts, summaries and checks over the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import percent_reduced, truncate
from lorekeep.sources.schemas import CATEGORIES


def visible_user_messages(messages: DataFrame) -> DataFrame:
    return messages.filter((F.col("role") == "user") & ~F.col("is_hidden"))


def export_stats(conversations: DataFrame, messages: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """One row: conversations (empty ones too), messages, visible user messages, characters of all messages, whether there is a profile."""
    counted = messages.agg(F.count("*").alias("messages"), F.count_if((F.col("role") == "user") & ~F.col("is_hidden")).alias("user_messages"), F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("characters"))
    out = conversations.agg(F.count("*").alias("conversations")).crossJoin(counted)  # one row each
    known = profile.limit(1).agg((F.count("*") > 0).alias("has_profile")) if profile is not None else None
    return out.crossJoin(known) if known is not None else out.withColumn("has_profile", F.lit(False))


def duplicate_ids(conversations: DataFrame) -> DataFrame:
    """(id, n) of ids that more than one conversation has; a missing id is the empty one."""
    return conversations.groupBy(F.coalesce("id", F.lit("")).alias("id")).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique_ids(conversations: DataFrame, shown: int = 5) -> None:
    """Raise with the first few ids, in order, and how many more there are."""
    twice = duplicate_ids(conversations)
    if first := [r.id for r in twice.orderBy("id").limit(shown).collect()]:
        more = twice.count() - len(first)
        raise ValueError("duplicate conversation ids: " + ", ".join(map(repr, first)) + (f" (and {more} more)" if more else ""))


def category_order() -> F.Column:
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))


def category_summary(aggregated: DataFrame) -> DataFrame:
    """(category, unique_facts, mentions), and TOTAL."""
    return aggregated.rollup("category").agg(F.count("*").alias("unique_facts"), F.sum("frequency").cast("long").alias("mentions"), F.grouping("category").alias("g")).select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("category")).alias("category"), "unique_facts", F.coalesce("mentions", F.lit(0)).alias("mentions"))


def reduction_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """(category, n_before, n_after, n_reduced, percent), and TOTAL; 0 percent of nothing."""
    b = before.groupBy("category").agg(F.count("*").alias("b"))
    a = after.groupBy(F.col("category").alias("c")).agg(F.count("*").alias("a"))
    both = b.join(a, F.col("category").eqNullSafe(F.col("c")), "full").select(F.coalesce("category", "c").alias("category"), F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("a", F.lit(0)).alias("a"))
    out = both.rollup("category").agg(F.coalesce(F.sum("b"), F.lit(0)).alias("n_before"), F.coalesce(F.sum("a"), F.lit(0)).alias("n_after"), F.grouping("category").alias("g"))
    return out.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("category")).alias("category"), "n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_reduced"), F.round(percent_reduced("n_before", "n_after"), 1).alias("percent"))


def frequency_histogram(aggregated: DataFrame) -> DataFrame:
    """(once, twice, more): how many facts were mentioned so often."""
    return aggregated.agg(F.count_if(F.col("frequency") == 1).alias("once"), F.count_if(F.col("frequency") == 2).alias("twice"), F.count_if(F.col("frequency") >= 3).alias("more"))


def category_breakdown(aggregated: DataFrame) -> DataFrame:
    """(category, n), the largest first, the first seen of equals."""
    return aggregated.groupBy("category").agg(F.count("*").alias("n"), F.min("first_ord").alias("first_ord")).orderBy(F.desc("n"), "first_ord").drop("first_ord")


def top_facts(aggregated: DataFrame, k: int = 10, width: int = 60) -> DataFrame:
    """The k most frequent facts, the first seen of equals; long ones cut."""
    return aggregated.orderBy(F.desc("frequency"), "first_ord").limit(k).select(truncate("fact", width).alias("fact"), "category", "frequency")


def profile_summary(profile_facts: DataFrame, shown: int = 2) -> DataFrame:
    """(category, n, preview) of every category of the taxonomy, and TOTAL."""
    spark = profile_facts.sparkSession
    names = spark.createDataFrame(list(enumerate(CATEGORIES)), "at int, category string")
    counted = profile_facts.groupBy("category").agg(F.count("*").alias("n"), F.min_by("fact", "ord").alias("p1"), F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "fact"))), lambda x: x["fact"]), 1, shown), "; ").alias("preview"))
    rows = names.join(counted, "category", "left").select("at", "category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("preview", F.lit("")).alias("preview"))
    total = rows.agg(F.lit(len(CATEGORIES)).alias("at"), F.lit("TOTAL").alias("category"), F.sum("n").alias("n"), F.lit("").alias("preview"))
    return rows.unionByName(total).orderBy("at").drop("at")


def chunk_table(chunks: DataFrame, shown: int | None = 10) -> DataFrame:
    """(chunk_id, n_conversations, tokens) of the first chunks, and the totals over all as chunk_id -1."""
    each = chunks.groupBy("chunk_id").agg(F.count("*").alias("n_conversations"), F.sum("tokens").cast("long").alias("tokens"))
    total = each.agg(F.lit(-1).cast(each.schema["chunk_id"].dataType).alias("chunk_id"), F.sum("n_conversations").alias("n_conversations"), F.sum("tokens").alias("tokens"))
    return (each.orderBy("chunk_id").limit(shown) if shown else each).unionByName(total)


def call_stats(calls: DataFrame) -> DataFrame:
    """One row over a log (n_in, n_out, seconds): calls, sums and averages."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return calls.agg(F.count("*").alias("calls"), F.coalesce(F.sum("n_in"), F.lit(0)).alias("facts_in"), F.coalesce(F.sum("n_out"), F.lit(0)).alias("facts_out"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), mean("n_in").alias("mean_in"), mean("seconds").alias("mean_seconds"))


def pipeline_summary(**counts: int) -> list[tuple[str, int]]:
    """The stages' counts, in order, for display."""
    return list(counts.items())
