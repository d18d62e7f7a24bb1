"""Facts from chunks through a provider. A chunk that fails is told in its row and does not stop the others."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.providers import Provider
from lorekeep.sources.schemas import CATEGORIES

KEYS = ["fact", "category", "source_convo_id", "source_timestamp", "source_quote"]
_TEXT = {"type": "string"}


def _listed(properties: dict) -> dict:
    item = {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}
    return {"type": "object", "properties": {"facts": {"type": "array", "items": item}}, "required": ["facts"], "additionalProperties": False}


FACT_SCHEMA = _listed({"fact": _TEXT, "category": {"type": "string", "enum": CATEGORIES}, "source_convo_id": _TEXT, "source_timestamp": {"type": "number"}, "source_quote": _TEXT})
DEDUP_SCHEMA = _listed({"fact": _TEXT, "category": _TEXT, "period": _TEXT})
_DATED = {"type": "array", "items": {"type": "object", "properties": {"fact": _TEXT, "period": _TEXT}, "required": ["fact", "period"], "additionalProperties": False}}
DISTILL_SCHEMA = {
    "type": "object",
    "properties": {"name": _TEXT, "categories": {"type": "object", "properties": dict.fromkeys(CATEGORIES, _DATED), "required": CATEGORIES, "additionalProperties": False}},
    "required": ["name", "categories"],
    "additionalProperties": False,
}
EXTRACT_PROMPT = "List what the conversations below say about their user: one fact each, with its category, the conversation's ID, its time, and 5 to 15 words quoted as they stand.\n\n"
DEDUP_PROMPT = "Of facts below that mean the same, keep the most recent, specific, frequent or explicit one, unchanged. Keep both where something changed over time.\n\n"
DISTILL_PROMPT = "Arrange the facts below by category, the most important first. Join related ones, tell past ones in the past tense, and keep their periods.\n\n"


def prompt_file(path: str) -> str:
    """A prompt of one's own, in place of the ones above; a file that is missing is an error, never a fallback."""
    at = Path(path)
    if not at.is_file():
        raise FileNotFoundError(f"no prompt at {path}")
    return at.read_text(encoding="utf-8")


def extract(chunks: DataFrame, make: Callable[[], Provider], tasks: int | None = None, prompt: str = EXTRACT_PROMPT) -> DataFrame:
    """(chunk_id, status, error, facts json) of each chunk (chunk_id, content). `tasks` calls go on at once; 1 is one after the other.

    Write the result once before using it twice: a model may answer otherwise the next time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for f in frames:
            rows = []
            for chunk, content in zip(f["chunk_id"], f["content"], strict=True):
                try:
                    got = provider.complete_structured(prompt + content, FACT_SCHEMA)
                    rows.append((chunk, "ok", None, json.dumps(got.get("facts") or [])))
                except Exception as e:  # kept with the chunk, which a later run takes up again
                    rows.append((chunk, "failed", f"{type(e).__name__}: {e}", "[]"))
            yield pd.DataFrame(rows, columns=["chunk_id", "status", "error", "facts"])

    dealt = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "content")
    dealt = dealt.coalesce(1) if tasks == 1 else dealt.repartition(tasks, "chunk_id") if tasks else dealt
    return dealt.mapInPandas(run, "chunk_id long, status string, error string, facts string")


def fact_rows(results: DataFrame) -> DataFrame:
    """The facts of all chunks, in order of chunk and place. Rows that lack a key or a numeric time go; category_valid tells whether the category is known."""
    shape = "array<map<string,string>>"
    each = results.filter("status = 'ok'").select("chunk_id", F.posexplode(F.from_json("facts", shape)).alias("at", "m"))
    fields = each.select("chunk_id", "at", *[F.try_element_at("m", F.lit(k)).alias(k) for k in KEYS]).withColumn("source_timestamp", F.expr("try_cast(source_timestamp AS double)"))
    whole = fields.dropna(subset=KEYS).filter(~F.isnan("source_timestamp") & (F.abs("source_timestamp") < math.inf))
    return whole.select((F.col("chunk_id") * 1_000_000 + F.col("at")).alias("fact_ord"), *KEYS, F.col("category").isin(CATEGORIES).alias("category_valid"), "chunk_id")


def model_merger(make: Callable[[], Provider], prompt: str = DEDUP_PROMPT):
    """A merger that asks a provider. Malformed items go; a missing period is empty; kept facts keep their order."""

    def merge(facts: pd.DataFrame) -> pd.DataFrame:
        if not len(facts):
            return facts
        asked = json.dumps(facts[["fact", "category", "period"]].to_dict("records"), indent=2)
        got = make().complete_structured(prompt + asked, DEDUP_SCHEMA).get("facts") or []
        rows = [(int(facts["ord"].iloc[min(k, len(facts) - 1)]), str(x["fact"]), str(x["category"]), str(x.get("period", ""))) for k, x in enumerate(got) if isinstance(x, dict) and "fact" in x and "category" in x]
        return pd.DataFrame(rows, columns=["ord", "fact", "category", "period"])

    return merge
