"""Semantic deduplication in batches: within categories, then across them.

A merger takes the facts of one batch and keeps the best of each group of duplicates; it is a model behind a provider,
or the deterministic one below. Every round is one grouped pass that runs in parallel over runs of two batches at most,
whatever a category or the table holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import normalize_text, period
from lorekeep.operators import durable

#: Facts that a merger sees at once.
BATCH = 50
FACTS = "ord long, fact string, category string, period string"
#: Takes and gives (ord, fact, category, period); what it gives is a part of what it took.
Merger = Callable[[pd.DataFrame], pd.DataFrame]


#: Runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Words of 64 bits that are compared at once.
AT_ONCE = 1 << 19


def words(text: str) -> frozenset[str]:
    return frozenset(WORD.findall(text.lower()))


def alike(texts: list[str], similar: float) -> np.ndarray:
    """Which pairs of texts have words with Jaccard similarity of `similar` or more; none with itself."""
    sets, place = [words(t) for t in texts], {}
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    word = np.fromiter((place.setdefault(w, len(place)) for s in sets for w in s), np.int64, int(size.sum()))
    row, shared = np.repeat(np.arange(len(sets)), size), np.bincount(word, minlength=len(place)) > 1
    at = (np.cumsum(shared) - 1)[word]
    row, at = row[shared[word]], at[shared[word]]
    bits = np.zeros((len(sets), max(1, -(-int(shared.sum()) // 64))), np.uint64)
    np.bitwise_or.at(bits, (row, at >> 6), np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)))
    out = np.empty((len(sets), len(sets)), bool)
    step = max(1, AT_ONCE // max(1, bits.size))
    for a in range(0, len(sets), step):
        both = np.bitwise_count(bits[a : a + step, None] & bits[None]).sum(axis=2, dtype=np.int64)
        out[a : a + step] = both >= similar * (size[a : a + step, None] + size - both)
    np.fill_diagonal(out, False)
    return out


def keep_best(facts: pd.DataFrame, similar: float = 0.8) -> pd.DataFrame:
    """Deterministic merger: of facts whose words are alike (Jaccard), the latest period, then the longest text, then the first.

    Facts that differ more are different or a change of state, and all stay.
    """
    near = alike(facts["fact"].tolist(), similar)
    if not near.any():
        return facts.sort_index()
    rows = pd.DataFrame({"end": facts["period"].fillna("").str[-10:].to_numpy(), "n": facts["fact"].str.len().to_numpy(), "ord": facts["ord"].to_numpy()})
    kept = np.zeros(len(facts), bool)
    for i in rows.sort_values(["end", "n", "ord"], ascending=[False, False, True], kind="stable").index:
        kept[i] = not near[i, kept].any()
    return facts[kept].sort_index()


#: A merger may have this: whether it would leave all these texts, and any part of them, as they are.
keep_best.idle = lambda texts: not alike(texts, 0.8).any()


def batches(aggregated: DataFrame, size: int = BATCH) -> DataFrame:
    """Facts with `batch`: within a category by time, oldest first, in runs of `size`."""
    placed = durable.numbered(aggregated, ["category"], ["source_timestamp", "first_ord"], "batch")
    return placed.withColumn("batch", F.floor(F.col("batch") / size))


def as_deduped(aggregated: DataFrame) -> DataFrame:
    return aggregated.select(F.col("first_ord").alias("ord"), "fact", "category", period("min_timestamp", "max_timestamp").alias("period"))


def _round(facts: DataFrame, keys: list[str], merger: Merger, size: int, tasks: int | None = None) -> DataFrame:
    extra = [c for c in facts.columns if c not in ("ord", "fact", "category", "period")]
    shape = FACTS + "".join(f", {c} {facts.schema[c].dataType.simpleString()}" for c in extra)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ord").select(names)
        if idle and idle(rows.column("fact").to_pylist()):
            return rows
        f = rows.to_pandas()
        out = merge_sorted(f[["ord", "fact", "category", "period"]].reset_index(drop=True), merger, size)
        return pa.Table.from_pandas(out.assign(**{c: f[c].iloc[0] for c in extra})[names], schema=rows.schema, preserve_index=False)

    idle, names = getattr(merger, "idle", None), [c.split()[0] for c in shape.split(", ")]
    return (facts.repartition(tasks, *keys) if tasks else facts).groupBy(*keys).applyInArrow(run, shape)


def merge_sorted(facts: pd.DataFrame, merger: Merger, size: int = BATCH) -> pd.DataFrame:
    """Halves until they fit a call, merge, join, merge; what stays too large is swept from the front while it shrinks."""
    if not len(facts):
        return facts
    if len(facts) <= size:
        return merger(facts).reset_index(drop=True)
    half = len(facts) // 2
    both = pd.concat([merge_sorted(facts.iloc[:half].reset_index(drop=True), merger, size), merge_sorted(facts.iloc[half:].reset_index(drop=True), merger, size)], ignore_index=True)
    while len(both) > size:
        now = pd.concat([merger(both.iloc[:size].reset_index(drop=True)), both.iloc[size:]], ignore_index=True)
        if len(now) >= len(both):
            return now
        both = now
    return merger(both).reset_index(drop=True)


def _settle(facts: DataFrame, keys: list[str], merger: Merger, size: int, store: Callable[[DataFrame], DataFrame], tasks: int | None) -> DataFrame:
    """Rounds over runs of two batches, in order of (batch, ord) within the keys; every other round they begin a batch later.

    Done once a run holds all of each key, or two rounds in turn took nothing away.
    """
    now, before, unchanged, shift = facts, -1, 0, 0
    while True:
        sizes = now.groupBy(*keys).count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
        unchanged = unchanged + 1 if sizes.n == before else 0
        if unchanged == 2:
            return now
        last, shift, before = (sizes.most or 0) <= 2 * size, 0 if (sizes.most or 0) <= 2 * size else shift, sizes.n

        def merged(now=now, shift=shift) -> DataFrame:
            placed = durable.numbered(now, keys, ["batch", "ord"])
            return _round(placed.withColumn("batch", F.floor((F.col("at") + shift) / (2 * size))).drop("at"), [*keys, "batch"], merger, size, tasks)

        made = durable.settled(merged, store)
        if now is not facts:
            durable.release(now)
        now, shift = made, size - shift
        if last:
            return now


def dedup_categories(aggregated: DataFrame, merger: Merger = keep_best, size: int = BATCH, store: Callable[[DataFrame], DataFrame] = durable.stored, tasks: int | None = None) -> DataFrame:
    """Batches of each category merged, then neighbouring batches, round by round, while that takes facts away.

    `store` writes each round and gives it back, so that a model is not asked twice; `tasks` bounds the calls at once.
    """

    def merged() -> DataFrame:
        dealt = batches(aggregated, size).select(F.col("first_ord").alias("ord"), "fact", "category", period("min_timestamp", "max_timestamp").alias("period"), F.col("batch").cast("long").alias("batch"))
        return _round(dealt, ["category", "batch"], merger, size, tasks)

    return _settle(durable.settled(merged, store), ["category"], merger, size, store, tasks).drop("batch")


def deduplicate(aggregated: DataFrame, merger: Merger = keep_best, size: int = BATCH, store: Callable[[DataFrame], DataFrame] = durable.stored, tasks: int | None = None) -> DataFrame:
    """Both phases: within categories, then across them in order of `ord`, in the same rounds."""
    first = dedup_categories(aggregated, merger, size, store, tasks)
    return _settle(first.withColumn("batch", F.lit(0).cast("long")), [], merger, size, store, tasks).drop("batch")


def dedup_exact(aggregated: DataFrame) -> DataFrame:
    """Within a category and period-free reading, one fact for each normalised text, by built-in operators alone: newest, longest, most frequent, first."""
    best = Window.partitionBy("category", normalize_text("fact")).orderBy(F.desc("max_timestamp"), F.desc(F.length("fact")), F.desc("frequency"), "first_ord")
    return aggregated.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


#: Vectors in one block at least, and at most; two blocks meet in a task. Up to MOST in each there are BLOCKS blocks, so that the
#: shuffle grows no faster than the rows. Rows that are compared with all others at once. All bound memory; none changes a result.
VECTORS, MOST, BLOCKS, COMPARED = 2048, 1 << 16, 32, 256


def _linked(similar: float):
    """Rows (id, v, norm) of two blocks: each row that is linked there, with the least id of its component."""

    def run(key, rows):
        ids = rows.column("id").to_numpy()
        v = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order].astype(np.float64) / rows.column("norm").to_numpy()[order][:, None]
        label, linked = np.arange(len(ids)), np.zeros(len(ids), bool)
        for a in range(0, len(ids), COMPARED):
            near = v[a : a + COMPARED] @ v.T >= similar
            near[np.arange(len(near)), np.arange(a, a + len(near))] = False
            linked[a : a + COMPARED] = near.any(axis=1)
        waiting = np.flatnonzero(linked)
        while len(waiting):  # a component is walked from its least id
            first, waiting = waiting[0], waiting[1:]
            front = np.array([first])
            while len(front) and len(waiting):
                near = np.zeros(len(waiting), bool)
                for a in range(0, len(front), COMPARED):
                    near |= (v[waiting] @ v[front[a : a + COMPARED]].T >= similar).any(axis=1)
                front, waiting = waiting[near], waiting[~near]
                label[front] = first
        out = label != np.arange(len(ids))
        return pa.table({"u": pa.array(ids[out]), "v": pa.array(ids[label[out]])})

    return run


def cluster_by_embedding(vectors: DataFrame, similar: float = 0.85, block: int = 0) -> DataFrame:
    """(id, cluster): the least id that is reachable from a row (id long, embedding) over pairs of cosine `similar` or more.

    All rows of one width are compared, block by block, so the work grows with the square of the rows. Vectors that are null,
    of no length or not finite link to none; singletons are clusters of their own.
    """
    plain = vectors.schema["embedding"].dataType.simpleString() == "array<float>"  # half as long, and doubles only in the task
    unit = vectors.select(F.col("id").cast("long").alias("id"), "embedding", F.expr("transform(embedding, x -> cast(x AS double))").alias("v")).filter("id IS NOT NULL")
    unit = unit.withColumn("norm", F.expr("sqrt(aggregate(v, 0D, (s, y) -> s + y * y))")).filter("norm > 0 AND NOT isnan(norm) AND norm < double('Infinity')")
    unit = unit.select("id", F.col("embedding" if plain else "v").alias("v"), "norm", F.size("v").alias("width"))
    n = unit.count()
    blocks = max(1, -(-n // (block or max(VECTORS, min(MOST, -(-n // BLOCKS))))))
    dealt = unit.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    met = dealt.withColumn("other", other).select("id", "v", "norm", "width", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    links = met.groupBy("width", "x", "y").applyInArrow(_linked(similar), "u long, v long").distinct()
    links = durable.stored(links)
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    named, moved = both.select(F.col("u").alias("id"), F.col("u").alias("cluster")).distinct(), 1
    last = named
    while moved:
        heard = both.join(named, both["v"] == named["id"]).groupBy("u").agg(F.min("cluster").alias("_heard"))
        now = named.join(heard, named["id"] == heard["u"]).select("id", F.least("cluster", "_heard").alias("_to"), (F.col("_heard") < F.col("cluster")).alias("_moved"))
        now = durable.stored(now)
        moved = now.filter("_moved").count()
        durable.release(last)
        last, named = now, now.select("id", F.col("_to").alias("cluster"))
    durable.release(links)
    return vectors.select("id").join(named, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))
