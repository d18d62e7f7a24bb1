"""Benchmark decontamination by a prefix-filtered containment join.

The windows of the benchmark items are ordered by how rare their shingles are in the documents. A window that occurs
whole needs every shingle of it, so its rarest one is a sufficient prefix: document shingles are joined on it, the
shingle's place in the window and the length of window and document bound where the window can lie, and the words there
are then compared one by one. Benchmarks are dealt into blocks of bounded size, each broadcast for one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import LOWER, slices, starts_of, texts_of, tokens

WINDOW = 10
SHINGLE = 3
#: Characters of the items in one block: what is broadcast at once is a small multiple of this.
BLOCK_CHARS = 2_000_000
#: Words are digits, lower-case letters and whatever is not ASCII; all else separates.
WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in LOWER)
SPANS = "doc_id long, n_words long, hit_from array<long>, hit_to array<long>, item_ids array<long>"


class Block:
    """The windows of some items over their own vocabulary."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window = window
        flat, counts = tokens(texts_of(pa.array([t or "" for _, t in items], pa.string()), WORDS))
        self.vocabulary = pc.unique(flat)
        ids = pc.index_in(flat, self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        found: dict[tuple, set] = {}
        at = starts_of(counts)
        for k, (item, _) in enumerate(items):
            words = ids[at[k] : at[k + 1]].tolist()
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i : i + window]), set()).add(item)
        self.length = np.array([len(w) for w in found], np.int64)
        self.words = np.array([[*w, *[0] * (window - len(w))] for w in found], np.int64).reshape(-1, window)
        self.items = [sorted(x) for x in found.values()]
        self.base = len(self.vocabulary) + 1
        if self.base >= 1 << 21:
            raise ValueError("a block's vocabulary must fit 21 bits: lower BLOCK_CHARS")
        self.sizes = np.minimum(self.length, SHINGLE)
        self.codes = {k: np.unique(self.all_codes(k)[0]) for k in np.unique(self.sizes).tolist()}

    def all_codes(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, window, offset) of every shingle of the windows whose shingles have k words."""
        out = []
        for w in np.flatnonzero(self.sizes == k).tolist():
            n = int(self.length[w]) - k + 1
            out.append((coded(self.words[w, : n + k - 1], k, self.base), np.full(n, w), np.arange(n)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def choose(self, seen: dict[tuple[int, int], int]) -> None:
        """Set each window's prefix, its rarest shingle in the documents; a tie goes to the lesser code."""
        self.prefix = {}
        for k in self.codes:
            code, window, offset = self.all_codes(k)
            often = np.array([seen.get((k, c), 0) for c in code.tolist()], np.int64)
            order = np.lexsort((code, often, window))
            first = order[np.concatenate([[True], np.diff(window[order]) > 0])]
            # A window whose rarest shingle no document has can not occur.
            first = first[often[first] > 0]
            first = first[np.argsort(code[first], kind="stable")]
            self.prefix[k] = code[first], window[first], offset[first]


def coded(ids: np.ndarray, k: int, base: int) -> np.ndarray:
    """A number for each k consecutive ids."""
    n = max(0, len(ids) - k + 1)
    out = np.zeros(n, np.int64)
    for j in range(k):
        out = out * base + ids[j : j + n]
    return out


def _in_document(block: Block, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat, counts = tokens(texts_of(texts, WORDS))
    ids = pc.fill_null(pc.index_in(flat, block.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return ids, counts


def _whole(ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Positions at which k known words of one document begin."""
    n = max(0, len(ids) - k + 1)
    good = row[:n] == row[k - 1 : k - 1 + n]
    for j in range(k):
        good &= ids[j : j + n] > 0
    return np.flatnonzero(good)


def _counter(block: Block):
    def run(batches) -> Iterator[pa.RecordBatch]:
        seen = {k: np.zeros(len(c), np.int64) for k, c in block.codes.items()}
        for b in slices(batches):
            ids, counts = _in_document(block, b.column(1))
            row = np.repeat(np.arange(len(counts)), counts)
            for k, codes in block.codes.items():
                got = coded(ids, k, block.base)[_whole(ids, row, k)]
                at = np.minimum(np.searchsorted(codes, got), len(codes) - 1)
                seen[k] += np.bincount(at[codes[at] == got], minlength=len(codes))
        for k, codes in block.codes.items():
            some = seen[k] > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), k)), pa.array(codes[some]), pa.array(seen[k][some])], ["k", "code", "n"])

    return run


def _finder(block: Block):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, counts = _in_document(block, b.column(1))
            at, row = starts_of(counts), np.repeat(np.arange(len(counts)), counts)
            hits = [(np.zeros(0, np.int64),) * 2]
            for k, (codes, window, offset) in block.prefix.items():
                pos = _whole(ids, row, k)
                got = coded(ids, k, block.base)[pos]
                lo, hi = np.searchsorted(codes, got), np.searchsorted(codes, got, "right")
                pos, lo, n = pos[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
                ends = np.cumsum(n)
                i = 0
                while i < len(pos):  # so many candidates at a time that memory is bounded
                    j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 200_000, "right")))
                    m = n[i:j]
                    p = np.repeat(lo[i:j], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    where, w = np.repeat(pos[i:j], m), window[p]
                    doc, start = row[where], where - offset[p]
                    fit = (start >= at[doc]) & (start + block.length[w] <= at[doc + 1])
                    start, w = start[fit], w[fit]
                    words = ids[np.minimum(start[:, None] + np.arange(block.window), max(len(ids) - 1, 0))]
                    same = ((words == block.words[w]) | (np.arange(block.window) >= block.length[w][:, None])).all(axis=1)
                    hits.append((start[same], w[same]))
                    i = j
            start, w = (np.concatenate(x) for x in zip(*hits))
            cover = np.zeros(len(ids) + 1, np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + block.length[w], -1)
            hit = np.cumsum(cover[:-1]) > 0
            begin = hit & ~(np.concatenate([[False], hit[:-1]]) & (np.concatenate([[-1], row[:-1]]) == row))
            end = hit & ~(np.concatenate([hit[1:], [False]]) & (np.concatenate([row[1:], [-1]]) == row))
            begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
            items: list[set] = [set() for _ in range(len(counts))]
            if len(start):
                for d, x in np.unique(np.stack([row[start], w]), axis=1).T.tolist():
                    items[d].update(block.items[x])
            spans = starts_of(np.bincount(row[begin], minlength=len(counts))).astype(np.int32) if len(begin) else np.zeros(len(counts) + 1, np.int32)
            base = at[row[begin]] if len(begin) else np.zeros(0, np.int64)
            ends = end - base if len(begin) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(spans), pa.array(begin - base)), pa.ListArray.from_arrays(pa.array(spans), pa.array(ends)), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))],
                ["doc_id", "n_words", "hit_from", "hit_to", "item_ids"],
            )

    return run


def blocks_of(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks; the driver holds one block at a time. An item longer than a block is one of its own."""
    now, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        if now and size + len(text) > block_chars:
            yield now
            now, size = [], 0
        now.append((item, text))
        size += len(text)
    yield now


def _merged(frames) -> Iterator:
    for f in frames:
        for r in f.itertuples(index=False):
            spans: list[list[int]] = []
            for a, b in sorted((int(a), int(b)) for p in r.parts for a, b in zip(p["hit_from"], p["hit_to"], strict=True)):
                if spans and a < spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            items = sorted({int(x) for p in r.parts for x in p["item_ids"]})
            f2 = {"doc_id": [r.doc_id] * r.copies, "n_words": [r.n_words] * r.copies, "hit_from": [[s[0] for s in spans]] * r.copies, "hit_to": [[s[1] for s in spans]] * r.copies, "item_ids": [items] * r.copies}
            yield type(f)(f2).astype({"doc_id": f["doc_id"].dtype})


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_words, hit_from, hit_to, item_ids) of each document row.

    hit_from and hit_to bound the runs of hit words (from 0, end exclusive); item_ids are those with an occurring window.
    A null or wordless text has no words and no hits. Items with null id or text, or without words, match nothing.
    Repeated rows keep a row each; extra columns are ignored; empty tables give no rows or no hits.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for items in blocks_of(benchmark, block_chars):
        block = Block(items, window)
        seen = docs.mapInArrow(_counter(block), "k long, code long, n long").groupBy("k", "code").agg(F.sum("n").alias("n"))
        block.choose({(r.k, r.code): r.n for r in seen.collect()} if len(block.length) else {})  # no more rows than the block has shingles
        if len(found) == 0:
            single = docs.mapInArrow(_finder(block), SPANS)
        found.append(docs.mapInArrow(_keyed(block), SPANS + ", print long"))
    if len(found) == 1:
        return single
    # Blocks of one text meet under its id and a hash of its words' places; equal rows are counted, not lost.
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    grouped = every.groupBy("doc_id", "print", "n_words").agg(F.collect_set(F.struct("hit_from", "hit_to", "item_ids")).alias("parts"), (F.count("*") / len(found)).cast("int").alias("copies"))
    return grouped.mapInPandas(_merged, SPANS)


def _keyed(block: Block):
    def run(batches) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches):
            prints = pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in pc.fill_null(b.column(1), "").cast(pa.binary()).to_pylist()], pa.int64())
            for out in _finder(block)([b]):
                yield pa.RecordBatch.from_arrays([*out.columns, prints], [*out.schema.names, "print"])

    return run


def n_hit() -> Column:
    return F.aggregate(F.arrays_zip("hit_from", "hit_to"), F.lit(0).cast("long"), lambda n, x: n + x["hit_to"] - x["hit_from"])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows of documents that hold a benchmark window. Rows with a null doc_id stay."""
    bad = matches(docs, benchmark, window).filter(F.size("hit_from") > 0).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")
