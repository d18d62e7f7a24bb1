"""From an export to a profile, every stage a table that a later run finds again."""

from __future__ import annotations

import argparse
import hashlib
import itertools
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import token_estimate
from lorekeep.functions.tokens import Vocabulary
from lorekeep.operators import aggregate, dedup, distill, extract, packing, providers, render, resume, stats, verify
from lorekeep.sources import exports


@dataclass
class Settings:
    source: str
    folder: str
    output: str = "output"
    provider: str = "offline"
    options: dict = field(default_factory=dict)
    chunk_tokens: int = packing.CHUNK_TOKENS
    demo: bool = False
    resume: bool = True
    fuzzy: bool = True
    run_ts: float = 0.0
    tpm: int = providers.TPM
    rpm: int = providers.RPM
    vocabulary: str | None = None
    prompt: str | None = None

    @property
    def calls(self) -> int:
        """Calls at once: what the token budget of a remote model allows, one of a local one."""
        return 1 if self.provider == "local" else providers.max_concurrent(self.tpm)

    @property
    def limit(self) -> int:
        """Tokens of a chunk; a remote model's are chosen for it."""
        return packing.DEMO_TOKENS if self.demo else providers.safe_chunk_size() if self.provider == "api" else self.chunk_tokens

    def maker(self) -> Callable[[], providers.Provider]:
        """Makes the provider where it is called. Processes that call a remote model at once share its budget equally."""
        choice, options, share = self.provider, dict(self.options), (max(1, self.rpm // self.calls), max(1, self.tpm // self.calls))

        def make() -> providers.Provider:
            limit = {"limit": providers.process_limit(*share)} if choice == "api" else {}
            return providers.get_provider(choice, **limit | options)

        return make


#: Chunks whose facts a model's calls lay down at a time: what breaks off loses no more calls than these.
WAVE = 16


def run(spark: SparkSession, s: Settings) -> dict[str, Any]:
    """The tables of all stages, the paths written and the counts. A demo takes the first chunk only."""
    ok, _, why = exports.validate_input(spark, s.source)
    if not ok:
        raise FileNotFoundError(why)
    kind, conversations, messages, profile = exports.read_export(spark, s.source, s.run_ts)
    limit, make = s.limit, s.maker()
    count = Vocabulary(s.vocabulary) if s.vocabulary else None
    kept = resume.Manifest(spark, resume.checkpoint_path(s.folder, s.source), resume.file_hash(spark, s.source), limit=limit, provider=s.provider, demo=s.demo, run_ts=s.run_ts, **({"vocabulary": s.vocabulary} if s.vocabulary else {}))
    stage = kept.stage if s.resume else lambda name, make: kept.save(name, make())
    conversations, messages = stage("conversations", lambda: conversations), stage("messages", lambda: messages)
    stats.require_unique_ids(conversations)
    memories = exports.memories_path(spark, s.source)
    trusted = exports.trusted_context(exports.read_memories(spark, memories or s.source + ".none"), profile).first()

    chunks = stage("chunks", lambda: chunked(conversations, messages, limit, count))
    if s.demo:
        chunks = chunks.filter("chunk_id = 0")
    texts = stage("texts", lambda: render.conversation_text(messages))
    found = kept.load("extracted") if s.resume else None
    if found is None:
        kept.save("extracted", chunks.limit(0).select(F.col("chunk_id"), F.lit("").alias("status"), F.lit("").alias("error"), F.lit("").alias("facts")))
        found = kept.load("extracted")
    left = resume.remaining(chunks.select("chunk_id", "content"), resume.completed(found))
    prompt = extract.prompt_file(s.prompt) if s.prompt else extract.EXTRACT_PROMPT
    extracted = found
    for wave in waves(left, s.provider):
        extracted = kept.append("extracted", extract.extract(wave, make, s.calls, prompt))
    facts = extract.fact_rows(extracted)
    baseline = trusted.context if trusted else None
    # Later stages stand for the chunks that went well, and are made anew when others have joined them.
    went_well = resume.completed(extracted).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("chunk_id")).alias("h")).first()
    of = hashlib.sha256(json.dumps([went_well.n, went_well.h, s.fuzzy, baseline, sorted(s.options.items())], default=str).encode()).hexdigest()[:12]
    checked = stage(f"checked-{of}", lambda: verify.verify(facts, texts, s.fuzzy))
    merged = aggregate.aggregate_facts(verify.verified(checked))
    offline = s.provider == "offline"
    merger = dedup.keep_best if offline else extract.model_merger(make)
    rounds = itertools.count()
    deduped = stage(f"deduped-{of}", lambda: dedup.deduplicate(merged, merger, store=lambda df: stage(f"round-{of}-{next(rounds)}", lambda: df), tasks=None if offline else s.calls))
    origin = {"source": f"{kind} export ({conversations.count()} conversations)", "generated": str(s.run_ts)}
    made = distill.distill(deduped, **origin) if offline else distill.distill_by(deduped, make, baseline, **origin, store=lambda df: stage(f"distilled-{of}", lambda: df), tasks=s.calls)
    paths = distill.write_profile(made, s.output)
    paths.append(write_log(checked, s.output))
    counts = stats.pipeline_summary(chunks=chunks.count(), facts=facts.count(), verified=verify.verified(checked).count(), deduped=deduped.count())
    return {"kind": kind, "conversations": conversations, "messages": messages, "chunks": chunks, "checked": checked, "aggregated": merged, "deduped": deduped, "profile": made, "paths": paths, "trusted": baseline, "counts": counts}


def write_log(checked: DataFrame, folder: str) -> str:
    """hallucinations.log with an entry of every discarded fact, in order; a partition at a time comes to the driver."""
    rows = verify.discarded(checked).orderBy("fact_ord").toLocalIterator()
    parts = ("\n".join(r.line for r in some) for some in itertools.batched(rows, 1000))
    return distill.put_text(checked.sparkSession, f"{folder}/hallucinations.log", (("\n" if k else "") + p for k, p in enumerate(parts)))


def waves(left: DataFrame, provider: str) -> list[DataFrame]:
    """Chunks still to be asked about, in the order of their ids; rules, unlike a model, take them all at once."""
    ends = left.agg(F.min("chunk_id").alias("a"), F.max("chunk_id").alias("b")).first()
    if ends.a is None or provider == "offline":
        return [left] if ends.a is not None else []
    return [left.filter(F.col("chunk_id").between(a, a + WAVE - 1)) for a in range(ends.a, ends.b + 1, WAVE)]


def chunked(conversations: DataFrame, messages: DataFrame, limit: int, count: Vocabulary | None = None) -> DataFrame:
    """(chunk_id, n_conversations, tokens, content), by the counts of a vocabulary or the estimate."""
    tokens = count.column("rendered") if count else token_estimate("rendered")
    rendered = render.render_conversations(conversations, messages)
    parts = packing.prepare(conversations, messages, rendered, limit, *((count, tokens) if count else ()))
    key = F.struct("conv_ord", "part_num").alias("part_ord")
    heads = parts.select(key, "id", "title", "create_time").distinct()
    # Parts are rendered as conversations of their own; their order is that of conversation and part.
    lines = parts.select(key, F.col("msg_ord"), "message_id", "role", "content", "timestamp", "is_hidden")
    shown = render.render_conversations(heads.withColumnRenamed("part_ord", "conv_ord"), lines.withColumnRenamed("part_ord", "conv_ord")).withColumnRenamed("conv_ord", "part_ord")
    sized = shown.withColumn("tokens", tokens).withColumn("part_key", F.col("part_ord"))
    flat = sized.select(F.col("part_key.conv_ord").alias("c"), F.col("part_key.part_num").alias("p"), "rendered", "tokens")
    ordered = flat.withColumn("part_ord", F.format_string("%019d-%010d", "c", "p"))
    assigned = packing.pack(ordered.select("part_ord", "tokens"), limit).join(ordered.select("part_ord", "rendered"), "part_ord")
    return assigned.groupBy("chunk_id").agg(F.count("*").alias("n_conversations"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("part_ord", "rendered"))).alias("r")).select("chunk_id", "n_conversations", "tokens", F.array_join(F.transform("r", lambda x: x["rendered"]), "\n\n").alias("content"))


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="A profile from a chat export")
    p.add_argument("source")
    p.add_argument("--folder", default="checkpoints")
    p.add_argument("--output", default="output")
    p.add_argument("--provider", default="offline", choices=sorted(providers.PROVIDERS))
    p.add_argument("--chunk-size", type=int, default=packing.CHUNK_TOKENS)
    p.add_argument("--vocabulary", help="a tokenizers file to count tokens by")
    p.add_argument("--prompt", help="a file with the extraction prompt")
    p.add_argument("--tpm", type=int, default=providers.TPM)
    p.add_argument("--rpm", type=int, default=providers.RPM)
    p.add_argument("--demo", action="store_true")
    p.add_argument("--no-resume", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("lorekeep").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name, n in run(spark, Settings(a.source, a.folder, a.output, a.provider, chunk_tokens=a.chunk_size, demo=a.demo, resume=not a.no_resume, tpm=a.tpm, rpm=a.rpm, vocabulary=a.vocabulary, prompt=a.prompt))["counts"]:
        print(f"{name}: {n}")


if __name__ == "__main__":
    main()
