"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks. With a weight of p slots in every period of P, block k of a source is
released at slot floor(k P / p) and due by ceil((k + 1) P / p); earliest deadline first keeps every source within one
block of its share at all times. As all shares are whole at the end of a period, one period is a table from which the
slot of any block follows. When a source runs out, the others go on in a new phase at their shares of what is left of the weight.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERIOD = 1000
BLOCK = 64
#: The plan is made of at most so many phases and as many sources; it is broadcast.
SOURCES = 1000
#: Rows that one task ranks, about.
RANKED = 50_000


def shares(weights: list[float], period: int) -> list[int]:
    """Whole slots of each source in a period, by largest remainders, at least one each."""
    total = sum(weights)
    exact = [w / total * period for w in weights]
    out = [max(1, math.floor(x)) for x in exact]
    order = sorted(range(len(out)), key=lambda i: (math.floor(exact[i]) - exact[i], i))
    for i in order[: max(0, period - sum(out))]:
        out[i] += 1
    return out


def period_slots(share: list[int]) -> list[list[int]]:
    """The slots of each source's blocks in one period of sum(share) slots, earliest deadline first; ties to the first source."""
    period = sum(share)
    waiting = [(0, -(-period // p), i, 0) for i, p in enumerate(share)]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out: list[list[int]] = [[] for _ in share]
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, due, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i, k))
        _, i, k = heapq.heappop(ready)
        out[i].append(slot)
        if k + 1 < share[i]:
            heapq.heappush(waiting, ((k + 1) * period // share[i], -(-(k + 2) * period // share[i]), i, k + 1))
    return out


def phases(rows: list[int], share: list[int], block: int) -> list[tuple]:
    """(source, first block, end block, first slot, period, slots in a period, missing rows before) of each source in each phase."""
    left = [-(-n // block) for n in rows]
    done = [0] * len(rows)
    out, slot, missing = [], 0, 0
    while active := [i for i in range(len(rows)) if left[i]]:
        places = dict(zip(active, period_slots([share[i] for i in active]), strict=True))
        period = sum(share[i] for i in active)
        last = {i: (left[i] - 1) // share[i] * period + places[i][(left[i] - 1) % share[i]] for i in active}
        ended = min(active, key=last.__getitem__)
        length = last[ended] + 1
        for i in active:
            used = length // period * share[i] + sum(s < length % period for s in places[i])
            if used:
                out.append((i, done[i], done[i] + used, slot, period, places[i], missing))
            done[i] += used
            left[i] -= used
        slot += length
        missing += -rows[ended] % block  # the last block of the source that ran out may be short
    return out


def mix(docs: DataFrame, weights: dict | None = None, period: int = PERIOD, block: int = BLOCK) -> DataFrame:
    """docs with block, slot and position (all from 0): the order in which sources interleave at their weights.

    weights: by source; None takes the square root of each source's rows. A source without a weight, or with none above
    zero, gets the least share. Null is a source of its own. Every row comes once. Within a source the order is that of
    md5 of doc_id, then doc_id, then text; rows that repeat a doc_id follow each other. Columns of docs called block, slot or
    position are replaced; other columns stay. An empty table gives an empty result. More than SOURCES sources are refused.
    """
    spark = docs.sparkSession
    found = docs.groupBy("source").count().limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: merge small ones first")
    found = sorted(((r["source"], r["count"]) for r in found), key=lambda x: (x[0] is None, x[0]))
    rows = [n for _, n in found]
    if weights is None:
        wanted = [math.sqrt(n) for n in rows]
    else:
        given = [max(0.0, float(weights.get(s) or 0)) for s, _ in found]
        least = min([w for w in given if w > 0], default=1.0)
        wanted = [w or least / len(given) for w in given]
    plan = phases(rows, shares(wanted, max(period, len(rows))), block) if rows else []
    key = T.StructField("_source", docs.schema["source"].dataType)
    kinds = [T.StructField(f"_{n}", T.LongType()) for n in ("from", "to", "slot", "period")]
    schema = T.StructType([key, *kinds, T.StructField("_places", T.ArrayType(T.LongType())), T.StructField("_missing", T.LongType())])
    planned = spark.createDataFrame([(found[i][0], *rest) for i, *rest in plan], schema)

    # Ranks without one task for a whole source: count by leading hex digits of the hash, add up, rank within.
    digits = max(1, math.ceil(math.log(max(1, sum(rows)) / RANKED, 16))) if sum(rows) > RANKED else 1
    hashed = docs.drop("block", "slot", "position").withColumn("_md5", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("_cut", F.substring("_md5", 1, digits))
    before = Window.partitionBy("source").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = docs.select("source", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, digits).alias("_cut")).groupBy("source", "_cut").count()
    cuts = cuts.select(F.col("source").alias("_of"), F.col("_cut").alias("_part"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("source", "_cut").orderBy("_md5", *[c for c in ("doc_id", "text") if c in docs.columns])
    ranked = hashed.withColumn("_in", F.row_number().over(within) - 1)
    ranked = ranked.join(cuts, ranked["source"].eqNullSafe(cuts["_of"]) & (ranked["_cut"] == cuts["_part"])).withColumn("_rank", F.col("_before") + F.col("_in"))
    ranked = ranked.withColumn("block", F.floor(F.col("_rank") / block))
    # At most SOURCES * SOURCES rows, and period places for each phase: a bounded table.
    placed = ranked.join(F.broadcast(planned), ranked["source"].eqNullSafe(planned["_source"]) & (F.col("block") >= F.col("_from")) & (F.col("block") < F.col("_to")))
    k, size = F.col("block") - F.col("_from"), F.size("_places").cast("long")
    placed = placed.withColumn("slot", F.col("_slot") + F.floor(k / size) * F.col("_period") + F.get("_places", (k % size).cast("int")))
    placed = placed.withColumn("position", F.col("slot") * block + F.col("_rank") % block - F.col("_missing"))
    kept = [c for c in docs.columns if c not in ("block", "slot", "position")]
    return placed.select(*[ranked[c] for c in kept], "block", "slot", "position")
