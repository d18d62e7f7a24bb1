"""Line dedup by an exact set-similarity join.

A line is the set of its lower-cased words. Words are ordered by rarity: those that come up often in some slice of the input
by their counts, after all others (any order is right; rare words first are fast). Lines at least as similar as the
threshold share a word among the first |set| - ceil(t |set|) + 1: these prefix words meet in a join, where length and place
of the shared word rule out most pairs, and the rest are verified on the whole lines. A line goes if a line before it is as
similar; lines of equal sets, told by 128-bit hashes, need no pairs.

Where a line has very many likely partners with one word, it is first verified against a few of the earliest; only lines
that this leaves meet all others there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import setjoin
from lorekeep.llm.common import LOWER, Words, mixed, release, slices, starts_of, stored, texts_of
from lorekeep.llm.setjoin import Order, needed

SIMILAR = 0.8
#: Bytes of text taken at once: small enough that the arrays of a slice stay in the cache.
SLICE = 1 << 20
READ = "doc_id long, print long, n_lines int, n_prefix int, numbers array<int>, signs array<long>, others array<long>, words array<long>, times array<int>"


class Lines:
    """The lines of some texts: where each is, per text their numbers, per line its distinct words' hashes, in order, and two hashes of the set."""

    def __init__(self, column: pa.Array, order: Order | None = None):
        words = Words(texts_of(column, LOWER))
        self.bytes = words.bytes
        ends = np.flatnonzero(words.bytes == 10)
        self.begin = np.sort(np.concatenate([words.offsets[:-1], ends + 1]), kind="stable")
        self.end = np.sort(np.concatenate([words.offsets[1:], ends]), kind="stable")
        rows = np.searchsorted(words.offsets, ends, "right") - 1
        self.per_row = np.bincount(rows, minlength=len(column)).astype(np.int64) + 1
        self.row = np.repeat(np.arange(len(column)), self.per_row)
        self.number = np.arange(len(self.row)) - starts_of(self.per_row)[self.row]
        line = np.repeat(np.arange(len(self.row)), np.diff(np.append(np.searchsorted(words.start, self.begin), len(words.start))))
        codes, self.words = pd.factorize(words.hashes())
        self.times = np.bincount(codes, minlength=len(self.words))
        if order is not None:
            rank, self.words, self.uses = order.ranked(self.words)
            codes = rank[codes]
        both = np.sort(line << 32 | codes)
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        self.line, self.word = both >> 32, both & 0xFFFFFFFF
        self.size = np.bincount(self.line, minlength=len(self.row)).astype(np.int64)
        self.at = starts_of(self.size)
        self.sign = self._sums(mixed(self.words, 0x94D049BB133111EB))

    def _sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of well spread values stand for sets."""
        total = np.concatenate([[np.uint64(0)], np.cumsum(values[self.word], dtype=np.uint64)])
        return (total[self.at[1:]] - total[self.at[:-1]]).view(np.int64)

    def other(self) -> np.ndarray:
        return self._sums(mixed(self.words ^ np.uint64(0xD6E8FEB86659FD93), 0xC4CEB9FE1A85EC53))


def _read(t: float):
    """Per document its lines with words, by number and hashes, and how many prefix words they have; on a slice's first row also its frequent words."""

    def run(batches):
        ints = pa.int32()
        for b in slices(batches, limit=SLICE):
            x = Lines(b.column(1))
            full = x.size > 0
            at = pa.array(starts_of(np.bincount(x.row[full], minlength=b.num_rows)).astype(np.int32))
            prints = pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in texts_of(b.column(1)).cast(pa.binary()).to_pylist()], pa.int64())
            prefix = np.bincount(x.row, (x.size - needed(x.size, t) + 1) * full, b.num_rows)
            often = x.times >= setjoin.OFTEN
            first = pa.array(np.where(np.arange(b.num_rows + 1) > 0, often.sum(), 0).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (x.number[full].astype(np.int32), x.sign[full], x.other()[full])]
            counts = [pa.ListArray.from_arrays(first, pa.array(v)) for v in (x.words[often].view(np.int64), x.times[often].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), prints, pa.array(x.per_row).cast(ints), pa.array(prefix.astype(np.int32)), *lists, *counts], [c.split()[0] for c in READ.split(", ")])

    return run


def _earliest(x: Lines, ids: np.ndarray) -> np.ndarray:
    """Which lines are the first of their sets among these texts."""
    by = np.lexsort((x.number, ids[x.row], x.sign))
    first = np.zeros(len(x.sign), bool)
    first[by[np.concatenate([[True], np.diff(x.sign[by]) != 0])] if len(by) else by] = True
    return first & (x.size > 0)


def _prefixes(order: Order, t: float):
    def run(batches):
        for b in slices(batches, limit=SLICE):
            x, ids = Lines(b.column(1), order), b.column(0).to_numpy(zero_copy_only=False)
            place = np.arange(len(x.line)) - x.at[x.line]
            use = (place < (x.size - needed(x.size, t) + 1)[x.line]) & _earliest(x, ids)[x.line]
            line, word = x.line[use], x.word[use]
            maps = [m[line] for m in setjoin.maps_of(x.words[x.word], x.size)]
            yield setjoin.rows_of(x.words[word], x.uses[word], x.size[line], place[use], x.sign[line], ids[x.row[line]], x.number[line], maps, t)

    return run


def _place(doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mixed(mixed(doc.view(np.uint64)) + number.astype(np.uint64)).view(np.int64)


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sign, line) of the lines of the pairs, and few others: the filter spares the rest the shuffle."""
    places = pairs.select(F.explode(F.array(F.struct(F.col("a_doc").alias("d"), F.col("a_number").alias("n")), F.struct(F.col("b_doc").alias("d"), F.col("b_number").alias("n")))).alias("p"))
    bits = setjoin.marks(places.select("p.d", "p.n").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(_place(*(c.to_numpy(zero_copy_only=False) for c in b.columns)))], ["s"]) for b in batches), "s long"))

    def run(batches):
        for b in slices(batches, limit=SLICE):
            texts = texts_of(b.column(1), LOWER)
            lines = pc.split_pattern(texts, "\n")
            row = pc.list_parent_indices(lines).to_numpy().astype(np.int64)
            number = np.arange(len(row)) - starts_of(np.bincount(row, minlength=len(texts)))[row]
            told = lines.flatten().filter(pa.array(setjoin.marked(bits, _place(b.column(0).to_numpy(zero_copy_only=False)[row], number))))
            if len(told):
                yield pa.RecordBatch.from_arrays([pa.array(Lines(told).sign), told], ["sign", "line"])

    return docs.mapInArrow(run, "sign long, line string").dropDuplicates(["sign"])


def _alike(p: set, q: set, t: float) -> bool:
    both = len(p & q)
    return both >= t * (len(p) + len(q) - both) - 1e-9


def _verify(t: float):
    def run(batches):
        for b in batches:
            keep = [_alike(set(x.split()), set(y.split()), t) for x, y in zip(*(b.column(c).cast(pa.binary()).to_pylist() for c in ("x", "y")), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_())).select(["b", "b_doc", "b_number"])

    return run


def _similar(docs: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """(b, b_doc, b_number): the later lines of those pairs that are similar."""
    lines = _texts(docs, pairs)
    one, two = lines.select(F.col("sign").alias("a"), F.col("line").alias("x")), lines.select(F.col("sign").alias("b"), F.col("line").alias("y"))
    met = pairs.join(one, "a").join(two, "b").select("b", "b_doc", "b_number", "x", "y")
    return met.mapInArrow(_verify(t), "b long, b_doc long, b_number int").distinct()


def find(docs: DataFrame, t: float = SIMILAR) -> DataFrame:
    """(doc_id, print, n_lines, removed array<long>): the numbers, from 0, of each document's lines that repeat an earlier one.

    Lines are parted by newline and ordered by (doc_id, number). A line whose word set has Jaccard similarity of t or
    more with that of any line before it is removed; lines without words stay. A null text is one empty line. print is a
    hash of the text: rows that repeat doc_id and text get a row each, with the same lines removed. Rows with a null
    doc_id are left out. Extra columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    read = stored(docs.mapInArrow(_read(t), READ))
    order = setjoin.order_of(read.filter(F.size("words") > 0).select(F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("times").alias("n"))).alias("w")).select("w.word", "w.n"))
    rows = read.agg(F.sum(F.col("n_prefix").cast("long"))).first()[0] or 0
    met = stored(setjoin.joined(docs, _prefixes(order, t), rows, t))
    ends = ["a", "b", "a_doc", "a_number", "b_doc", "b_number"]
    pairs = stored(met.filter("key IS NULL").select(ends).distinct())
    gone = stored(_similar(docs, pairs, t))

    # Lines that the first of very many partners leave, against the others.
    crowd = met.filter("key IS NOT NULL").select("key", "shape", "b", "b_doc", "b_number", "crowded")
    left = crowd.filter("crowded").drop("crowded").join(gone, ["b", "b_doc", "b_number"], "left_anti")
    before = crowd.select("key", *[F.col(c).alias(n) for c, n in (("shape", "_shape"), ("b", "a"), ("b_doc", "a_doc"), ("b_number", "a_number"))])
    earlier = F.struct("a_doc", "a_number", "a") < F.struct("b_doc", "b_number", "b")
    rest = stored(left.join(before, "key").filter((F.col("a") != F.col("b")) & earlier & setjoin.fitting(t)).select(ends).distinct().join(pairs, ends, "left_anti"))
    release(met, pairs)
    late = gone if rest.isEmpty() else gone.unionByName(_similar(docs, rest, t))
    late = late.groupBy(F.col("b_doc").alias("doc_id")).agg(F.collect_set(F.struct(F.col("b_number").alias("number"), F.col("b").alias("sign"))).alias("late"))

    # Equal sets: all but the earliest line of each.
    lines = read.select("doc_id", "print", F.explode(F.arrays_zip("numbers", "signs", "others")).alias("l")).select("doc_id", "print", F.col("l.numbers").alias("number"), F.col("l.signs").alias("sign"), F.col("l.others").alias("other"))
    sets = lines.groupBy("sign", "other").agg(F.min(F.struct("doc_id", "number")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    equal = lines.join(sets, ["sign", "other"]).filter(F.col("first") != F.struct("doc_id", "number")).groupBy("doc_id", "print").agg(F.collect_set("number").alias("equal"))

    own = F.filter(F.arrays_zip(F.col("numbers").alias("number"), F.col("signs").alias("sign")), lambda l: F.array_contains("late", l))
    late_numbers = F.when(F.col("late").isNull(), F.array().cast("array<int>")).otherwise(F.transform(own, lambda l: l["number"]))
    removed = F.array_sort(F.array_union(late_numbers, F.coalesce("equal", F.array().cast("array<int>")))).cast("array<long>")
    out = read.select("doc_id", "print", "n_lines", "numbers", "signs").join(equal, ["doc_id", "print"], "left").join(late, "doc_id", "left")
    return out.select("doc_id", "print", F.col("n_lines").cast("long").alias("n_lines"), removed.alias("removed"))


def clean(docs: DataFrame, t: float = SIMILAR) -> DataFrame:
    """docs with repeated lines taken out of text; every row stays, though its text may be left empty. Rows without removed lines are unchanged."""
    bad = find(docs, t).filter(F.size("removed") > 0).select(F.col("doc_id").alias("_id"), "print", "removed").groupBy("_id").agg(F.collect_set(F.struct("print", "removed")).alias("_bad"))
    met = docs.join(bad, docs["doc_id"] == bad["_id"], "left")
    return met.select(*[F.pandas_udf(_edited, "string")("text", "_bad").alias(c) if c == "text" else docs[c] for c in docs.columns])


def _edited(texts, bads):
    import pandas as pd

    out = []
    for text, bad in zip(texts, bads, strict=True):
        if bad is not None and text is not None:
            mark = xxhash.xxh3_64_intdigest(text.encode()) >> 1
            for x in bad:
                if x["print"] == mark:
                    gone = {int(k) for k in x["removed"]}
                    text = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)
                    break
        out.append(text)
    return pd.Series(out, dtype=object)
