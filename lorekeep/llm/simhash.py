"""SimHash near-dedup by deletion-variant signatures.

Fingerprints within two bits share, in one of two 32-bit segments, all bits but one. Each segment is indexed under its
32 one-wildcard variants; equal variants meet in an equality join and are verified. Variants that very many
fingerprints share are not paired: their members are keyed again so finely that all members of a key are within two
bits of each other, and a star around the least member links them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import LOWER, slices, starts_of, stored, texts_of
from lorekeep.llm.components import components

SHINGLE = 3
#: Variants with more fingerprints are linked by stars instead of pairs. Either way gives the same links.
PAIRED = 64


def fingerprint(texts: list[bytes]) -> np.ndarray:
    """One 64-bit SimHash of each lower-cased text."""
    hashes, counts, h = [], [], xxhash.xxh64_intdigest
    for t in texts:
        words = t.split()
        if len(words) < SHINGLE:
            hashes += [h(b" ".join(words), 42)] if words else []
            counts.append(min(len(words), 1))
            continue
        line = b" ".join(words)
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        hashes += [h(line[a:b], 42) for a, b in zip([0, *(e + 1 for e in ends[:-SHINGLE])], ends[SHINGLE - 1 :])]
        counts.append(len(words) - SHINGLE + 1)
    n = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    if full := np.flatnonzero(n).tolist():
        each, at = np.array(hashes, np.uint64), starts_of(n)
        ones = np.zeros((len(full), 64), np.int64)
        for k, i in enumerate(full):
            for a in range(at[i], at[i + 1], 1 << 16):
                bits = np.unpackbits(each[a : min(a + (1 << 16), at[i + 1])].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones[k] += bits.sum(axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > n[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _prints(batches):
    for b in slices(batches):
        texts = texts_of(b.column(1), LOWER).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprint(texts).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of each row; a null, empty or blank text has fingerprint zero."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_prints, "doc_id long, fp long")


def _segment(fp: str, k: str) -> str:
    return f"(shiftrightunsigned({fp}, 32 * ({k})) & 4294967295L)"


def _meet(batches):
    """Rows (sign, fp) sorted by sign: pairs within two bits of signs with few prints (hot false), rows of the others (hot true)."""
    held_s, held_f, crowded = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

    def flush(sign, fp, whole):
        nonlocal held_s, held_f, crowded
        first = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]])) if len(sign) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([first, [len(sign)]]))
        many = size > PAIRED
        if crowded is not None and len(sign) and sign[0] == crowded:
            many[0] = True
        last = first[-1] if len(first) else 0
        if not whole and len(first):  # the last run may go on: keep it, unless it is known to be crowded
            crowded = int(sign[last]) if many[-1] else None
            cut = len(sign) if many[-1] else last
            held_s, held_f = sign[cut:], fp[cut:]
        else:
            cut, held_s, held_f = len(sign), sign[:0], fp[:0]
        hot = np.repeat(many, size)[:cut]
        sign, fp = sign[:cut], fp[:cut]
        us, vs = [], []
        for d in range(1, PAIRED):
            same = (sign[d:] == sign[:-d]) & ~hot[d:]
            if not same.any():
                break
            i = np.flatnonzero(same)
            x, y, slot = fp[i], fp[i + d], sign[i] >> 32
            differ = x ^ y
            segment = (differ >> (32 * (slot // 32)).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
            # Equal segments meet in all their variants: the first one is enough.
            ok = (np.bitwise_count(differ) <= 2) & ((segment > 0) | (slot % 32 == 0))
            us.append(x[ok].view(np.int64))
            vs.append(y[ok].view(np.int64))
        us.append(fp[hot].view(np.int64))
        vs.append(sign[hot])
        u, v = np.concatenate(us), np.concatenate(vs)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.arange(len(u)) >= len(u) - hot.sum())], ["u", "v", "hot"])

    for b in batches:
        sign = np.concatenate([held_s, b.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([held_f, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        yield from flush(sign, fp, False)
    yield from flush(held_s, held_f, True)


def links(prints: DataFrame) -> DataFrame:
    """(u, v) edges of distinct fingerprints (fp): their components are those of all pairs within two bits.

    One shuffle brings the variants together, sorted, and a pass of bounded memory pairs them.
    """
    variant = F.expr(f"transform(sequence(0L, 63L), b -> shiftleft(b, 32) | ({_segment('fp', 'cast(b div 32 AS int)')} & ~shiftleft(1L, cast(b % 32 AS int))))")
    signs = prints.select(F.explode(variant).alias("sign"), "fp")
    met = stored(signs.repartition("sign").sortWithinPartitions("sign").mapInArrow(_meet, "u long, v long, hot boolean"))
    pairs = met.filter("NOT hot").select("u", "v").distinct()
    hot = met.filter("hot").select(F.col("u").alias("fp"), F.col("v").alias("sign"))

    # The segment is equal: two wildcards in the other one. It differs in the wildcard: one wildcard in the other one.
    other = _segment("fp", "1 - cast(seg AS int)")
    same = hot.select("fp", F.expr("shiftright(sign, 37)").alias("seg")).distinct()
    same = same.select(
        "fp",
        F.explode(F.expr(f"flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> struct(seg * 1024 + i * 32 + j AS slot, {_segment('fp', 'cast(seg AS int)')} AS x, {other} & ~(shiftleft(1L, i) | shiftleft(1L, j)) AS y))))")).alias("key"),
    )
    wild = hot.select("fp", "sign", F.expr("shiftright(sign, 37)").alias("seg"))
    wild = wild.select("fp", F.explode(F.expr(f"transform(sequence(0, 31), i -> struct(4096L + i AS slot, sign AS x, {other} & ~shiftleft(1L, i) AS y))")).alias("key"))
    fine = same.unionByName(wild)
    star = fine.groupBy("key").agg(F.min("fp").alias("m"), F.max("fp").alias("most")).filter("m < most").select("key", "m")
    star = fine.join(star, "key").filter("fp != m").select(F.col("fp").alias("u"), F.col("m").alias("v")).distinct()
    return pairs.unionByName(star)


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, component_id): component_id is the least doc_id reachable over links of at most two bits.

    Rows with a null doc_id are left out, as nothing could name them. Repeated rows of a doc_id keep a row each. Extra
    columns are ignored; an empty table gives an empty result.
    """
    each = stored(fingerprints(docs).filter("doc_id IS NOT NULL"))
    least = stored(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(least.select("fp")))
    grouped = least.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(ids, "root").select("fp", "component_id")
    return each.join(named, "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate group: that of the group's least doc_id.

    Rows that repeat both doc_id and text become one. Rows with a null doc_id stay: nothing names them.
    """
    keep = near_groups(docs).select(F.col("component_id").alias("_keep")).distinct()
    kept = docs.join(keep, docs["doc_id"] == keep["_keep"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter("doc_id IS NULL"))
