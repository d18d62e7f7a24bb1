"""Exact top-k inner-product search by MaxScore.

A query's terms are its dimensions; a shard's posting of a term holds that component of each of its vectors. Each term
has bounds on what it can add in a shard. Terms are taken from the widest bounds down: the essential ones, without which
no vector can reach the score to beat, are traversed for all vectors of the shard; the others are probed only for vectors
whose partial score and remaining bound stay competitive. Ties stay competitive, so results are exact. Shards merge by
rank. Queries are dealt into blocks of bounded size, each broadcast for one pass over the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10
SCALE = 1024
#: Queries in one block, and vectors in one shard: both bound memory and change no result.
BLOCK = 4096
SHARD = 4096
#: Terms that are probed at once.
STEP = 8


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component. Null ids, null vectors and vectors with a null or non-finite component are left out."""
    fine = "embedding IS NOT NULL AND vec_id IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(fine).select("vec_id", F.expr(f"transform(embedding, x -> cast(floor({scale}D * cast(x AS double)) AS long))").alias("v"))


def top_of_shard(queries: np.ndarray, query_ids: np.ndarray, beat: np.ndarray, ids: np.ndarray, shard: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, vec_ids, scores) of each query's best k of the shard that reach beat; beat rises to each query's k-th best score."""
    if float(np.abs(queries).max()) * float(np.abs(shard).max()) * shard.shape[1] < 1 << 53:  # then doubles hold every sum exactly
        queries, shard = queries.astype(np.float64), shard.astype(np.float64)
    low, high = shard.min(axis=0), shard.max(axis=0)
    columns = np.ascontiguousarray(shard.T)
    out = []
    for i, q in enumerate(queries):
        most, least = np.maximum(q * low, q * high), np.minimum(q * low, q * high)
        order = np.argsort(least - most, kind="stable")
        rest = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0]])  # the bound of the terms from here on
        # Essential: leaving out these and keeping the best of all others does not reach the score to beat.
        lost = np.cumsum((most - least)[order])
        essential = max(1, int(np.searchsorted(lost, most.sum() - beat[i], "right")) + 1) if beat[i] > np.iinfo(np.int64).min else len(q)
        essential = min(essential, len(q))
        score = q[order[:essential]] @ columns[order[:essential]]
        alive = np.flatnonzero(score + rest[essential] >= beat[i])
        score = score[alive]
        for at in range(essential, len(q), STEP):
            if not len(alive):
                break
            terms = order[at : at + STEP]
            score = score + q[terms] @ columns[np.ix_(terms, alive)] if len(alive) < len(ids) // 2 else score + (q[terms] @ columns[terms])[alive]
            keep = score + rest[min(at + STEP, len(q))] >= beat[i]
            alive, score = alive[keep], score[keep]
        own = ids[alive] != query_ids[i]
        alive, score = alive[own], score[own]
        if not len(alive):
            continue
        if len(alive) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            alive, score = alive[score >= cut], score[score >= cut]
        best = np.lexsort((ids[alive], -score))[:k]
        if len(best) == k:
            beat[i] = max(beat[i], score[best[-1]])
        out.append((i, ids[alive[best]], score[best].astype(np.int64)))
    return out


def _searcher(query_ids: np.ndarray, queries: np.ndarray, k: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        beat = np.full(len(queries), np.iinfo(np.int64).min)
        kept_id, kept_score, kept_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def best() -> None:
            ids, score, of = (np.concatenate(x) for x in (kept_id, kept_score, kept_q))
            order = np.lexsort((ids, -score, of))
            ids, score, of = ids[order], score[order], of[order]
            rank = np.arange(len(of)) - np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])[np.cumsum(np.concatenate([[0], np.diff(of) != 0]))] if len(of) else of
            kept_id[:], kept_score[:], kept_q[:] = [ids[rank < k]], [score[rank < k]], [of[rank < k]]

        for b in batches:
            for at in range(0, b.num_rows, SHARD):
                part = b.slice(at, SHARD)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                shard = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                for i, found, score in top_of_shard(queries, query_ids, beat, ids, shard, k):
                    kept_id.append(found)
                    kept_score.append(score)
                    kept_q.append(np.full(len(found), i))
                if len(kept_id) > 8 * len(queries):
                    best()
        best()
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[kept_q[0]]), pa.array(kept_id[0]), pa.array(kept_score[0])], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, scale: int = SCALE) -> DataFrame:
    """(query_id, rank int, vec_id, score long): each query's k highest scores among vectors of other ids, ties to the lesser vec_id.

    vectors and queries: (vec_id, embedding). Vectors of a length other than the query's take no part against it.
    Repeated ids count as a candidate each; a query id that repeats is asked with its least vector. Empty tables give an empty result. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    all_vectors = quantised(vectors, scale)
    asked = quantised(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    parts = []
    for size, n in asked.groupBy(F.size("v").alias("size")).count().orderBy("size").collect():
        if size == 0:
            continue
        deals = max(1, -(-n // block))
        of = F.pmod(F.xxhash64("vec_id"), F.lit(deals))
        for d in range(deals):
            rows = asked.filter((F.size("v") == size) & (of == d)).collect()  # about a block of rows
            if rows:
                ids, v = np.array([r.vec_id for r in rows], np.int64), np.array([r.v for r in rows], np.int64)
                parts.append(all_vectors.filter(F.size("v") == size).mapInArrow(_searcher(ids, v, k), "query_id long, vec_id long, score long"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
