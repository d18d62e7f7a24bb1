"""Profiles: facts by category, and their two files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import durable, render
from lorekeep.operators.extract import DISTILL_PROMPT, DISTILL_SCHEMA
from lorekeep.operators.providers import Provider
from lorekeep.sources.schemas import CATEGORIES

#: Facts that one call arranges. As many or fewer are arranged by a single call.
AT_ONCE = 1000


def profile_facts(deduped: DataFrame) -> DataFrame:
    """(category_ord, category, ord, fact, period): facts of known categories, in the taxonomy's order."""
    at = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    return deduped.filter(F.col("category").isin(CATEGORIES)).select(at.cast("int").alias("category_ord"), "category", "ord", "fact", "period")


def distill(deduped: DataFrame, name: str = "User", source: str = "Unknown", generated: str = "") -> DataFrame:
    """One row (name, categories map, generated, source, fact_count); every category is there, empty or not."""
    spark = deduped.sparkSession
    names = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    grouped = profile_facts(deduped).groupBy("category").agg(F.array_sort(F.collect_list(F.struct("ord", "fact", "period"))).alias("f"))
    each = names.join(grouped, "category", "left").select("category", F.coalesce(F.transform("f", lambda x: F.struct(x["fact"].alias("fact"), x["period"].alias("period"))), F.expr("cast(array() AS array<struct<fact:string,period:string>>)")).alias("facts"))
    count = deduped.agg(F.count("*").cast("int").alias("fact_count"))
    packed = each.agg(F.map_from_entries(F.collect_list(F.struct("category", "facts"))).alias("categories"))
    return packed.crossJoin(count).select(F.lit(name).alias("name"), "categories", F.lit(generated).alias("generated"), F.lit(source).alias("source"), "fact_count")  # one row each


def distill_by(deduped: DataFrame, make: Callable[[], Provider], trusted: str | None = None, source: str = "Unknown", generated: str = "", at_once: int = AT_ONCE, store: Callable[[DataFrame], DataFrame] = durable.stored, tasks: int = 1) -> DataFrame:
    """The profile as a provider arranges it, with the trusted baseline kept as it is worded; the same row as distill().

    Facts are dealt by category and order into runs of `at_once`, each asked about by one call in a task; the answers follow one
    another. The baseline goes with the first run, so that it is told once. Items that lack a fact and unknown categories go;
    without facts nothing is asked. `store` writes the answers once.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for f in frames:
            answers = [provider.complete_structured(p, DISTILL_SCHEMA) for p in f["prompt"]]
            rows = []
            for run, got in zip(f["run"], answers, strict=True):
                listed = got.get("categories")
                listed = listed if isinstance(listed, dict) else {}
                facts = [(c, x) for c in CATEGORIES for x in listed.get(c) or [] if isinstance(x, dict) and "fact" in x]
                rows.append((run, str(got.get("name") or "User"), json.dumps([{"fact": str(x["fact"]), "category": c, "period": str(x.get("period") or "")} for c, x in facts])))
            yield pd.DataFrame(rows, columns=["run", "name", "facts"])

    def asked() -> DataFrame:
        placed = durable.numbered(deduped.select("ord", "fact", "category", "period"), [], ["category", "ord", "fact"])
        runs = render.facts_json(placed.withColumn("run", F.floor(F.col("at") / at_once)), ["fact", "category", "period"], ["run"])
        prompt = F.when(F.col("run") == 0, render.build_prompt(DISTILL_PROMPT, F.col("json"), trusted)).otherwise(render.build_prompt(DISTILL_PROMPT, F.col("json")))
        return runs.select("run", prompt.alias("prompt")).repartition(tasks, "run").mapInPandas(ask, "run long, name string, facts string")

    answers = durable.settled(asked, store)
    shape = "array<struct<fact:string,category:string,period:string>>"
    each = answers.select("run", F.posexplode(F.from_json("facts", shape)).alias("at", "x")).select((F.col("run") * 1_000_000 + F.col("at")).alias("ord"), "x.*")
    first = answers.filter("run = 0").select("name").first()
    return distill(each, first.name if first else "User", source, generated).withColumn("fact_count", F.lit(deduped.count()).cast("int"))


def markdown(profile: DataFrame) -> DataFrame:
    """(text): the profile as Markdown; categories in order, empty ones left out."""
    line = lambda x: F.concat(F.lit("- "), x["fact"], F.when(F.coalesce(x["period"], F.lit("")) != "", F.concat(F.lit(" *("), x["period"], F.lit(")*"))).otherwise(F.lit("")), F.lit("\n"))
    parts = [F.concat(F.lit(f"# Memory Profile for "), "name", F.lit("\n\n> Generated: "), "generated", F.lit("\n> Source: "), "source", F.lit("\n\n"))]
    for c in CATEGORIES:
        facts = F.coalesce(F.try_element_at("categories", F.lit(c)), F.expr("cast(array() AS array<struct<fact:string,period:string>>)"))
        parts.append(F.when(F.size(facts) > 0, F.concat(F.lit(f"## {c.title()}\n\n"), F.array_join(F.transform(facts, line), ""), F.lit("\n"))).otherwise(F.lit("")))
    return profile.select(F.concat(*parts).alias("text"))


def profile_json(profile: DataFrame) -> str:
    """The one profile as indented JSON, without its count."""
    row = profile.select(F.to_json(F.struct("name", "generated", "source", "categories")).alias("j")).first()
    data = json.loads(row.j)
    data["categories"] = {c: data["categories"].get(c, []) for c in CATEGORIES}
    return json.dumps(data, indent=2)


def put_text(spark: SparkSession, path: str, text: str | Iterable[str]) -> str:
    """Write one file whole, from a text or its parts in turn: to a name beside it first, then renamed over the old one."""
    hadoop = spark._jvm.org.apache.hadoop
    at, beside = hadoop.fs.Path(path), hadoop.fs.Path(path + ".part")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    try:
        for part in [text] if isinstance(text, str) else text:
            out.write(bytearray(part.encode()))
    finally:
        out.close()
    # One step: whoever reads, and whatever breaks off, finds the old file or the new one.
    context = hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
    options[0] = hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(beside), fs.makeQualified(at), options)
    return path


def write_profile(profile: DataFrame | None, folder: str) -> list[str]:
    """Both files, memory-profile.md and memory-profile.json; nothing without a profile."""
    if profile is None:
        return []
    spark = profile.sparkSession
    return [put_text(spark, f"{folder}/memory-profile.md", markdown(profile).first().text), put_text(spark, f"{folder}/memory-profile.json", profile_json(profile))]
