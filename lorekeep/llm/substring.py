"""Substring dedup with difference-cover anchors.

COVER is a difference cover modulo PERIOD: any two places in two documents have a common step below PERIOD that takes
both to cover positions. So two equal windows of WINDOW words share an anchor, a run of WINDOW - PERIOD + 1 words that
begins at a cover position of either document. Only anchors are hashed and joined; where an anchor repeats, it is
extended to the windows around it, and these are joined by a 128-bit hash of all their words.

Documents whose text repeats whole need no extension, as all their windows repeat; one of them stands for all against
other texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import mixed, slices, starts_of, stored, texts_of, tokens

WINDOW = 35
#: Every difference modulo 21 is that of exactly one pair of the cover.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
#: Bits of the filter that spares other documents' texts a shuffle. It bounds memory and changes no result.
FILTER = 1 << 26
_B = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(h: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` consecutive word hashes from each start, modulo 2^64."""
    n = len(h) + 1
    inverse = np.uint64(pow(int(_B), -1, 1 << 64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers(len(h), _B), dtype=np.uint64)])
    x = (sums[start + length] - sums[start]) * _powers(n, inverse)[start]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each word, and the words of each text."""
    flat, counts = tokens(texts_of(texts))
    d = flat.dictionary_encode()
    both = [xxhash.xxh3_128_digest(w) for w in d.dictionary.cast(pa.binary()).to_pylist()]
    both = np.frombuffer(b"".join(both), np.uint64).reshape(-1, 2)[d.indices.to_numpy(zero_copy_only=False)]
    return both[:, 0], both[:, 1], counts


def _spread(keys: np.ndarray, *hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first hash, sure) of the rows of a slice.

    Rows that have an equal within the slice are sure to repeat. One of them goes on under its hash and tells rows of other
    slices; the rest get a hash of their own, so that a group of very many copies is not gathered in one task.
    """
    by = np.argsort(hashes[0], kind="stable")
    same = np.ones(max(0, len(by) - 1), bool)
    for h in hashes:
        same &= h[by][1:] == h[by][:-1]
    later, sure = np.zeros(len(by), bool), np.zeros(len(by), bool)
    later[by[1:]] = same
    sure[by[1:]] = same
    sure[by[:-1]] |= same
    own = mixed(keys.astype(np.int64).view(np.uint64) + np.arange(len(by), dtype=np.uint64) * _B)
    return np.where(later, own, hashes[0]).view(np.int64), sure


def _anchors(batches):
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    for b in slices(batches):
        h, _, counts = _hashed(b.column(1))
        at = starts_of(counts)
        row = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(row)) - at[row]
        use = np.flatnonzero(cover[place % PERIOD] & (place + ANCHOR <= counts[row]) & (counts[row] >= WINDOW))
        keys = b.column(0).to_numpy(zero_copy_only=False)[row[use]]
        hashed, sure = _spread(keys, rolling(h, use, ANCHOR))
        yield pa.RecordBatch.from_arrays([pa.array(hashed), pa.array(keys), pa.array(place[use].astype(np.int32)), pa.array(sure)], ["hash", "key", "place", "sure"])


def _windows(batches):
    """Rows (hash, more, key, place, sure) of the windows that hold a repeated anchor."""
    for b in slices(batches):
        h, g, counts = _hashed(b.column(1))
        at = starts_of(counts)
        lists = b.column(2)
        row = pc.list_parent_indices(lists).to_numpy()
        anchor = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        # Windows begin at an anchor or up to PERIOD - 1 words before it.
        mark = np.zeros(at[-1] + 1, np.int64)
        ok = anchor < counts[row]
        row, anchor = row[ok], anchor[ok]
        np.add.at(mark, at[row] + np.maximum(0, anchor - PERIOD + 1), 1)
        np.add.at(mark, at[row] + anchor + 1, -1)
        start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        of = np.repeat(np.arange(len(counts)), counts)[start]
        fit = start + WINDOW <= at[of + 1]
        start, of = start[fit], of[fit]
        keys, more = b.column(0).to_numpy(zero_copy_only=False)[of], rolling(g, start, WINDOW)
        hashed, sure = _spread(keys, rolling(h, start, WINDOW), more)
        yield pa.RecordBatch.from_arrays([pa.array(hashed), pa.array(more.view(np.int64)), pa.array(keys), pa.array((start - at[of]).astype(np.int32)), pa.array(sure)], ["hash", "more", "key", "place", "sure"])


def _repeated(width: int):
    """Of rows (..., key, place, sure) sorted by their first `width` columns: (key, place) of those that are sure or not alone. One row is held back."""

    def run(batches):
        held, joined = None, False
        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                columns = [np.concatenate([[x], c]) for x, c in zip(held, columns, strict=True)]
            n = len(columns[0])
            if not n:
                continue
            same = np.ones(n - 1, bool)
            for c in columns[:width]:
                same &= c[1:] == c[:-1]
            many = np.concatenate([[joined and held is not None], same]) | np.concatenate([same, [False]])
            out = np.flatnonzero((many | columns[width + 2].astype(bool))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(columns[width][out].astype(np.int64)), pa.array(columns[width + 1][out].astype(np.int32))], ["key", "place"])
            held, joined = [c[-1] for c in columns], bool(many[-1])
        if held is not None and (joined or held[width + 2]):
            yield pa.RecordBatch.from_arrays([pa.array([int(held[width])], pa.int64()), pa.array([int(held[width + 1])], pa.int32())], ["key", "place"])

    return run


def _remover(batches):
    """From (doc_id, text, whole, places): what is left of each text."""
    for b in slices(batches):
        rows = zip(pc.fill_null(b.column(1), "").cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True)
        n, gone, kept = [], [], []
        for text, whole, places in rows:
            words = text.split()
            n.append(len(words))
            if whole and len(words) >= WINDOW:
                gone.append(len(words))
                words = []
            elif places.is_valid and len(places.values):
                mark = np.zeros(len(words) + 1, np.int64)
                begin = np.unique(places.values.to_numpy(zero_copy_only=False))
                mark[begin] += 1
                mark[begin + WINDOW] -= 1
                hit = np.cumsum(mark[:-1]) > 0
                gone.append(int(hit.sum()))
                words = [words[k] for k in np.flatnonzero(~hit).tolist()]
            else:
                gone.append(0)
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])


def _filter_of(keys: DataFrame) -> np.ndarray:
    """Bits of the keys' low parts, FILTER in all."""
    marks = keys.select(F.shiftright(F.col("key").bitwiseAND(F.lit(FILTER - 1)), 5).alias("k"), F.expr("shiftleft(1L, cast(key & 31 AS int))").alias("bit")).groupBy("k").agg(F.bit_or("bit").alias("bit"))
    bits = np.zeros(FILTER // 32, np.uint32)
    for part in marks.toArrow().to_batches():  # FILTER / 32 rows at most
        bits[part.column(0).to_numpy()] = part.column(1).to_numpy().astype(np.uint32)
    return bits


def _maybe(bits: np.ndarray):
    import pandas as pd

    def run(key):
        low = key.to_numpy().view(np.uint64) & np.uint64(FILTER - 1)
        return pd.Series((bits[(low >> np.uint64(5)).astype(np.int64)] >> (low & np.uint64(31)).astype(np.uint32)) & 1 > 0)

    return F.pandas_udf(run, "boolean")


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) of each document row: the text without repeated windows.

    A word goes if a window of WINDOW words over it occurs elsewhere in the input too, in this or another row; windows are
    judged on the input, not on what is left. Words lie between ASCII white space and are joined by one space. A null text
    has none. Rows that repeat doc_id and text are copies of each other; extra columns are ignored; an empty table gives
    an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))  # names a row; equal rows are equal in all that follows
    anchors = docs.select("key", "text").mapInArrow(_anchors, "hash long, key long, place int, sure boolean")
    near = stored(anchors.repartition("hash").sortWithinPartitions("hash").mapInArrow(_repeated(1), "key long, place int"))

    # Whole copies: all of their windows repeat. The least key of a group stands for it.
    prints = docs.filter(F.length("text") >= 2 * WINDOW - 1).select("key", F.xxhash64("text").alias("p"), F.xxhash64("text", F.lit(1)).alias("q"))
    groups = prints.groupBy("p", "q").agg(F.count("*").alias("n"), F.min("key").alias("least")).filter("n > 1")
    copies = stored(prints.join(groups, ["p", "q"]).select("key", (F.col("key") != F.col("least")).alias("idle")).distinct())

    found = near.groupBy("key").agg(F.collect_set("place").alias("places")).join(copies, "key", "full")
    found = stored(found.select("key", F.coalesce("idle", F.lit(False)).alias("idle"), F.col("idle").isNotNull().alias("whole"), "places"))
    maybe = _maybe(_filter_of(found.select("key")))
    some = docs.filter(maybe("key"))
    extend = found.filter("NOT idle AND places IS NOT NULL").select("key", "places")
    # In order of the keys, a task that runs again cuts the same slices.
    windows = some.join(extend, "key").select("key", "text", "places").sortWithinPartitions("key").mapInArrow(_windows, "hash long, more long, key long, place int, sure boolean")
    ends = windows.repartition("hash", "more").sortWithinPartitions("hash", "more").mapInArrow(_repeated(2), "key long, place int").groupBy("key").agg(F.collect_set("place").alias("gone"))
    found = stored(found.select("key", "whole").join(ends, "key", "left"))

    shape = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
    none = F.lit(None).cast("array<int>")
    clean = docs.filter(~maybe("key")).select("doc_id", "text", F.lit(False).alias("whole"), none.alias("gone"))
    met = some.join(found, "key", "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "gone")
    return clean.unionByName(met).mapInArrow(_remover, shape)
