"""Near copies among documents by SimHash fingerprints, verified, and by an exact set-similarity join for what these do not reach.

Documents whose fingerprints op3's signatures link are verified on their whole sets first, and those that hold form groups.
Fingerprints of similar texts may differ in many more bits, so a join finds the other pairs; what is in a group by then is not
verified again.

A document is the set of its lower-cased runs of SHINGLE words; one with fewer words is the set of one run. Documents whose
sets are as similar as the threshold share a shingle among the first |set| - ceil(t |set|) + 1 in any common order, here
frequent shingles last. These meet in a join; pairs that length and place leave are verified on the whole sets, and linked
documents form groups. Where a document has very many likely partners with one shingle, it is verified against a few of the
earliest first; pairs of documents that these links leave in different groups are verified then.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import setjoin
from lorekeep.llm.common import LOWER, Words, mixed, release, slices, starts_of, stored, texts_of
from lorekeep.llm.components import components
from lorekeep.llm.setjoin import Order, needed
from lorekeep.llm.simhash import fingerprint, links as fingerprint_links

SHINGLE, SIMILAR = 5, 0.8
SLICE = 1 << 20


class Sets:
    """The distinct shingles of some texts, by hash: per text in order, its size and the hash of the set."""

    def __init__(self, column: pa.Array, shingle: int, order: Order | None = None):
        found = Words(texts_of(column, LOWER))
        words, row, n = found.hashes(), found.row, found.counts
        # A run ends at the end of its text; it is told if it is whole, or if it is the only one.
        at = np.arange(len(words)) - starts_of(n)[row]
        run, h = np.minimum(n, shingle)[row], np.zeros(len(words), np.uint64)
        begins = np.flatnonzero(at + run <= n[row])
        for k in range(shingle):
            on = begins[k < run[begins]]
            h[on] = mixed(h[on] * np.uint64(0x100000001B3) + words[on + k])
        codes, h = pd.factorize(h[begins])
        if order is not None:
            rank, h, uses = order.ranked(h)
            codes = rank[codes]
        both = np.sort(row[begins] << 32 | codes)
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        self.row, code = both >> 32, both & 0xFFFFFFFF
        self.hash, self.uses = h[code], uses[code] if order is not None else None
        self.size = np.bincount(self.row, minlength=len(n)).astype(np.int64)
        self.at = starts_of(self.size)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(self.hash, 0x94D049BB133111EB), dtype=np.uint64)])
        self.sign = (sums[self.at[1:]] - sums[self.at[:-1]]).view(np.int64)


def _read(shingle: int, t: float):
    """The hash of each document's set, its fingerprint and how many prefix shingles it has; on a slice's first row also the slice's frequent shingles."""

    def run(batches):
        for b in slices(batches, limit=SLICE):
            x = Sets(b.column(1), shingle)
            codes, h = pd.factorize(x.hash)
            n = np.bincount(codes, minlength=len(h))
            often = n >= setjoin.OFTEN
            first = pa.array(np.where(np.arange(b.num_rows + 1) > 0, often.sum(), 0).astype(np.int32))
            lists = [pa.ListArray.from_arrays(first, pa.array(v)) for v in (h[often].view(np.int64), n[often].astype(np.int32))]
            fp = fingerprint(texts_of(b.column(1), LOWER).cast(pa.binary()).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.sign), pa.array(fp), pa.array((x.size - needed(x.size, t) + 1).astype(np.int32)), *lists], ["doc_id", "sign", "fp", "n_prefix", "words", "times"])

    return run


def _prefixes(order: Order, shingle: int, t: float):
    def run(batches):
        for b in slices(batches, limit=SLICE):
            x = Sets(b.column(1), shingle, order)
            place = np.arange(len(x.row)) - x.at[x.row]
            use = place < (x.size - needed(x.size, t) + 1)[x.row]
            row, ids = x.row[use], b.column(0).to_numpy(zero_copy_only=False)
            none = np.zeros(len(row), np.int64)  # shingles are seldom shared by chance: the parity words are not needed
            yield setjoin.rows_of(x.hash[use], x.uses[use], x.size[row], place[use], x.sign[row], ids[row], none, [none, none], t)

    return run


def _texts(docs: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(sign, text) of the documents of the pairs (a, b), and few others: a filter spares the rest the shuffle."""
    bits = setjoin.marks(pairs.select(F.explode(F.array("a", "b")).alias("s")))

    def run(batches):
        for b in slices(batches, limit=SLICE):
            sign = Sets(b.column(1), shingle).sign
            keep = pa.array(setjoin.marked(bits, sign))
            yield pa.RecordBatch.from_arrays([pa.array(sign).filter(keep), b.column(1).filter(keep)], ["sign", "text"])

    return docs.mapInArrow(run, "sign long, text string").dropDuplicates(["sign"])


def _verified(docs: DataFrame, pairs: DataFrame, shingle: int, t: float) -> DataFrame:
    """The pairs (a, b) that are similar."""

    def run(batches):
        for b in slices(batches, text=2, limit=SLICE):
            x, y = Sets(b.column(2), shingle), Sets(b.column(3), shingle)
            both = np.array([len(np.intersect1d(x.hash[x.at[i] : x.at[i + 1]], y.hash[y.at[i] : y.at[i + 1]], assume_unique=True)) for i in range(b.num_rows)], np.int64)
            keep = pa.array(both >= t * (x.size + y.size - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    texts = _texts(docs, pairs, shingle)
    met = pairs.join(texts.select(F.col("sign").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("sign").alias("b"), F.col("text").alias("y")), "b")
    return stored(met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _alike(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of signs with linked fingerprints: a star around the least sign of each fingerprint (sign, fp), and links between those."""
    least = stored(prints.groupBy("fp").agg(F.min("sign").alias("least")))
    same = prints.join(least, "fp").select("sign", "least")
    links = fingerprint_links(least.select("fp"))
    ends = [least.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}")) for c in ("u", "v")]
    both = same.unionByName(links.join(ends[0], "u").join(ends[1], "v").select(F.col("_u").alias("sign"), F.col("_v").alias("least")))
    return stored(both.filter("sign != least").select(F.least("sign", "least").alias("a"), F.greatest("sign", "least").alias("b")).distinct())


def near_groups(docs: DataFrame, shingle: int = SHINGLE, t: float = SIMILAR) -> DataFrame:
    """(doc_id, component_id): component_id is the least doc_id reachable over pairs with Jaccard similarity of t or more.

    Texts without words are copies of each other. Rows with a null doc_id are left out; repeated rows keep a row each.
    Equal sets are told by a 64-bit hash.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
    read = stored(docs.mapInArrow(_read(shingle, t), "doc_id long, sign long, fp long, n_prefix int, words array<long>, times array<int>"))
    close = _verified(docs, _alike(stored(read.select("sign", "fp").distinct())), shingle, t)
    group = components(close.toDF("u", "v"))
    order = setjoin.order_of(read.filter(F.size("words") > 0).select(F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("times").alias("n"))).alias("w")).select("w.word", "w.n"))
    rows = read.agg(F.sum(F.col("n_prefix").cast("long"))).first()[0] or 0
    met = stored(setjoin.joined(docs, _prefixes(order, shingle, t), rows, t))
    pairs = stored(met.filter("key IS NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = [group.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in ("a", "b")]
    apart = stored(pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").filter("NOT coalesce(_a = _b, false)").select("a", "b"))
    # Groups are stars by now: their own edges are fewer than the links, and settle at once.
    root = components(group.toDF("u", "v").unionByName(_verified(docs, apart, shingle, t).toDF("u", "v")))

    crowd = met.filter("key IS NOT NULL").select("key", "shape", F.col("b").alias("sign"), "b_doc")
    if not crowd.isEmpty():
        # A pair that was not told is open only if its ends are in different groups: then one is in another than the crowd's first.
        placed = stored(crowd.join(root.withColumnRenamed("node", "sign"), "sign", "left").withColumn("root", F.coalesce("root", "sign")))
        first = placed.groupBy("key").agg(F.min(F.struct("b_doc", "sign", "root")).alias("first"))
        odd = placed.join(first, "key").filter("root != first.root").select("key", *[F.col(c).alias("_" + c) for c in ("shape", "sign", "root")])
        more = odd.join(placed, "key").filter((F.col("root") != F.col("_root")) & setjoin.fitting(t))
        rest = stored(more.select(F.least("sign", "_sign").alias("a"), F.greatest("sign", "_sign").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
        release(placed)
        if not rest.isEmpty():
            root = components(root.toDF("u", "v").unionByName(_verified(docs, rest, shingle, t).toDF("u", "v")))
    release(met, pairs)

    least = read.groupBy("sign").agg(F.min("doc_id").alias("least"))
    grouped = stored(least.join(root.withColumnRenamed("node", "sign"), "sign", "left").withColumn("root", F.coalesce("root", "sign")))
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return read.select("doc_id", "sign").join(grouped.join(ids, "root").select("sign", "component_id"), "sign").select("doc_id", "component_id")


def dedup(docs: DataFrame, shingle: int = SHINGLE, t: float = SIMILAR) -> DataFrame:
    """docs with one document of each group: that of the group's least doc_id.

    Rows that repeat both doc_id and text become one. Rows with a null doc_id stay: nothing names them.
    """
    keep = near_groups(docs, shingle, t).select(F.col("component_id").alias("_keep")).distinct()
    kept = docs.join(keep, docs["doc_id"] == keep["_keep"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter("doc_id IS NULL"))
