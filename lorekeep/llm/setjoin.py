"""Prefix-filtered set join: which rows that share a prefix member can still be similar.

A set's members are in an order that all sets share, rare ones first. Two sets of m and n members with Jaccard similarity t
or more share c = ceil(t / (1 + t) (m + n)) of them, so they share one among the first m - ceil(t m) + 1. Every set gives a
row for each of these prefix members; rows meet by member, and length and place of the member leave few pairs: a member at
place i of m still allows m - i common ones, so partners have between t m and (m - i)(1 + t) / t - m members. Rows also carry
two words of 64 bits, each bit the parity of the members that hash to it: two sets differ in as many members at least as
bits, which rules out most of those that share a prefix member by chance. Sets of up to WIDE members use the first word only.

Members with HOT uses or more meet by (member, band of sizes), so that the length filter is part of the key. Rows whose
partners in a group are very many give their first ones only and are marked as crowded: what these pairs leave open is for
the caller to look up among the crowd's rows.

Rows travel in packs, one for all rows of a bucket of members that some input gave at once: the shuffle and its sort see few
large rows, and a bucket's rows are sorted by numpy. Buckets grow in number with the rows, so each fits in memory; what one
member alone makes too large is told in parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import mixed, slices

#: A member counts for the order from so many uses in a slice on, and at most so many are told apart. Any order is right.
OFTEN, RANKED = 2, 1 << 18
#: Uses of a member from which on its rows are dealt by size as well.
HOT = 1 << 16
#: Partners of a row that are all told; those told of a row with more; rows of a group that are compared all with all;
#: the first rows of a larger group that all its rows are compared with before.
PAIRED, FEW, ALL_PAIRS, LEADERS = 8, 2, 256, 16
#: Rows taken at once, rows of one group held at most, and pairs compared at once. All bound memory; none changes a result.
AT_ONCE, HELD, COMPARED = 1 << 16, 1 << 19, 1 << 21
#: Rows expected in a bucket; rows gathered before they are parted into packs.
BUCKET, GATHERED = 1 << 15, 1 << 19
FILTER, WIDE = 1 << 26, 64
#: A pack holds rows by columns of 64 bits: key, shape (size and place), sign, doc_id, number and the two parity words.
PACKS, COLUMNS = "bucket int, pack binary", 7
MET = "a long, b long, a_doc long, a_number int, b_doc long, b_number int, key long, shape long, crowded boolean"


def needed(m: np.ndarray, t: float) -> np.ndarray:
    """ceil(t m), safe from rounding up a whole product."""
    return np.ceil(t * m - 1e-9).astype(np.int64)


class Order:
    """How often the frequent members are used, by hash."""

    def __init__(self, words: np.ndarray, times: np.ndarray):
        by = np.argsort(words)
        self.words, self.times = words[by], times[by]

    def uses(self, hashes: np.ndarray) -> np.ndarray:
        """The uses of each of these hashes; 0 for those that are not frequent."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.times[at], 0)

    def ranked(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rank of each of these distinct hashes by uses and hash; and by rank, the hashes and their uses."""
        by = np.argsort(hashes)
        uses = self.uses(hashes[by])  # in their order: near each other in the table
        often = np.flatnonzero(uses)
        often = often[np.argsort(uses[often], kind="stable")]
        order = np.concatenate([np.flatnonzero(uses == 0), often])
        by, rank = by[order], np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        return rank, hashes[by], uses[order]


def order_of(used: DataFrame) -> Order:
    """used: (word, n), counts in parts of the input."""
    ranked = used.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(RANKED).toArrow()
    return Order(ranked.column("word").to_numpy().view(np.uint64), ranked.column("n").to_numpy())


def rows_of(member: np.ndarray, uses: np.ndarray, size: np.ndarray, place: np.ndarray, sign, doc, number, maps, t: float) -> np.ndarray:
    """The rows of prefix members, by columns: those of hot ones in the band of their size, and in the next if a partner can be there."""
    key, hot = member, uses >= HOT
    again = np.zeros(0, np.int64)
    if hot.any():
        band = lambda m: np.floor(np.log(m) / -np.log(t) + 1e-9).astype(np.int64)
        of = band(np.maximum(size, 1))
        longest = np.maximum(np.floor((size - place) * (1 + t) / t - size + 1e-6), 1)
        again = np.flatnonzero(hot & (band(longest) > of))
        key = np.where(hot, mixed(member + of.astype(np.uint64)), member)
        key = np.concatenate([key, mixed(member[again] + (of[again] + 1).astype(np.uint64))])
    columns = [size << 32 | place, sign, doc, number, *maps]
    return np.stack([key.view(np.int64), *(np.concatenate([c, c[again]]) if len(again) else c for c in columns)])


def maps_of(member: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The parity words of sets from their members' hashes, set after set."""
    cell = (member >> np.uint64(20)) & np.uint64(127)
    cell = np.where(np.repeat(size > WIDE, size), cell, cell & np.uint64(63))
    bit = np.left_shift(np.uint64(1), cell & np.uint64(63))
    out, begin = [], (np.cumsum(size) - size)[size > 0]
    for k in (0, 1):
        x = np.zeros(len(size), np.uint64)
        if len(member):
            x[size > 0] = np.bitwise_xor.reduceat(np.where(cell >> np.uint64(6) == k, bit, np.uint64(0)), begin)
        out.append(x.view(np.int64))
    return out


def packed(prefixes, buckets: int):
    """prefixes: batches of the input to rows. PACKS of them."""

    def parted(x):
        x = x.take(np.argsort(x[0].view(np.uint64)), axis=1)
        bucket = ((x[0].view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        packs = pa.array([x[:, i:j].tobytes() for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)], strict=True)], pa.binary())
        return slices([pa.RecordBatch.from_arrays([pa.array(bucket[begin]), packs], ["bucket", "pack"])])

    def run(batches):
        held, rows = [], 0
        for x in prefixes(batches):
            held.append(x)
            rows += x.shape[1]
            if rows >= GATHERED:
                yield from parted(np.concatenate(held, axis=1))
                held, rows = [], 0
        if rows:
            yield from parted(np.concatenate(held, axis=1))

    return run


def joined(docs: DataFrame, prefixes, rows: int, t: float) -> DataFrame:
    """MET of the rows that prefixes gives for docs; rows: about how many there are."""
    packs = docs.mapInArrow(packed(prefixes, 1 + rows // BUCKET), PACKS)
    return packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet(t), MET)


def fits(m, i, n, j, t: float):
    """By length, and by what two sets can still share from their shared member on."""
    return (np.minimum(m, n) >= needed(np.maximum(m, n), t)) & (np.minimum(m - i, n - j) >= np.ceil(t / (1 + t) * (m + n) - 1e-9))


def fitting(t: float, a: str = "shape", b: str = "_shape") -> Column:
    """The same of two columns."""
    m, n = F.shiftright(a, 32), F.shiftright(b, 32)
    i, j = F.col(a).bitwiseAND(F.lit(0xFFFFFFFF)), F.col(b).bitwiseAND(F.lit(0xFFFFFFFF))
    return (F.least(m, n) >= F.ceil(t * F.greatest(m, n) - 1e-9)) & (F.least(m - i, n - j) >= F.ceil(t / (1 + t) * (m + n) - 1e-9))


def _spread(first: np.ndarray, last: np.ndarray):
    """(k, x) for every x from first[k] to last[k] (exclusive), at most COMPARED and one k's at a time."""
    many = np.maximum(last - first, 0)
    total = np.concatenate([[0], np.cumsum(many)])
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(total, total[at] + COMPARED, "right")) - 1)
        k = np.repeat(np.arange(at, to), many[at:to])
        yield k, np.arange(total[to] - total[at]) - np.repeat(total[at:to] - total[at], many[at:to]) + first[k]
        at = to


def _compared(x: np.ndarray, t: float):
    """Pairs (earlier, later) among sorted rows x (key, shape, sign, doc, number, maps) of whole groups, which later rows are crowded, and which rows are in a crowd."""
    key, shape, sign, doc, number, map0, map1 = x
    size, place = shape >> 32, shape & 0xFFFFFFFF
    count = len(key)
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, count)))
    members = np.bincount(group)
    rank = np.empty(count, np.int64)
    rank[np.lexsort((sign, number, doc))] = np.arange(count)
    where = group << 32 | size
    longest = np.floor((size - place) * (1 + t) / t - size + 1e-6).astype(np.int64)
    end = np.searchsorted(where, group << 32 | np.maximum(longest, 0), "right")
    big = members[group] > ALL_PAIRS
    found: list[np.ndarray] = []

    def likely(p, q):
        """Which of the pairs (p, q) may be similar."""
        at = np.flatnonzero((sign[p] != sign[q]) & fits(size[p], place[p], size[q], place[q], t))
        p, q = p[at], q[at]
        low, high = map0[p] ^ map0[q], map1[p] ^ map1[q]
        narrow = np.minimum(size[p], size[q]) <= WIDE
        low, high = np.where(narrow, low ^ high, low), np.where(narrow, 0, high)
        differ = np.bitwise_count(low.view(np.uint64)).astype(np.int64) + np.bitwise_count(high.view(np.uint64))
        return at[differ <= np.floor((1 - t) / (1 + t) * (size[p] + size[q]) + 1e-9)]

    def tell(p, q):
        ok = likely(p, q)
        p, q = p[ok], q[ok]
        swap = rank[p] > rank[q]
        found.append(np.stack([np.where(swap, q, p), np.where(swap, p, q)]))

    small = np.flatnonzero(~big)
    for k, q in _spread(small + 1, end[small]):
        tell(small[k], q)
    crowded = np.zeros(count, bool)
    for g in np.flatnonzero(members > ALL_PAIRS):
        rows = np.arange(begins[g], begins[g] + members[g])
        leaders = rows[np.argpartition(rank[rows], LEADERS)[:LEADERS]]
        leaders = leaders[np.argsort(rank[leaders])]
        had = np.zeros(len(rows), np.int64)
        for lead in leaders:
            ok = np.flatnonzero((had < FEW) & (rank[rows] > rank[lead]))
            ok = ok[likely(np.full(len(ok), lead), rows[ok])]
            found.append(np.stack([np.full(len(ok), lead), rows[ok]]))
            had[ok] += 1
        crowded[rows[had > 0]] = True
        lone = rows[had == 0]
        low = np.searchsorted(where, g << 32 | needed(size[lone], t))
        for k, p in _spread(low, end[lone]):
            later = rank[lone[k]] > rank[p]
            tell(p[later], lone[k][later])
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    by = np.lexsort((rank[a], b))
    a, b = a[by], b[by]
    begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    many = np.diff(np.append(begin, len(b)))
    crowded[b[begin[many > PAIRED]]] = True
    nth = np.arange(len(b)) - np.repeat(begin, many)
    keep = (nth < FEW) | (np.repeat(many, many) <= PAIRED)
    crowd = np.bincount(group, crowded) > 0
    return a[keep], b[keep], crowded, crowd[group]


def _runs(key: np.ndarray) -> np.ndarray:
    """How many of these sorted keys equal each."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    many = np.diff(np.append(begin, len(key)))
    return np.repeat(many, many)


def _ordered(x: np.ndarray, alone: bool) -> np.ndarray:
    """Rows by key, shape and sign; a set comes once for a key, at its earliest place. alone: also rows that meet no other."""
    by = np.argsort(x[0])
    key = x[0, by]
    if not alone:
        met = _runs(key) > 1
        by, key = by[met], key[met]
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]), dtype=np.int64)[: len(key)]
    where = group << 32 | x[1, by] >> 32  # a set has one place for a key
    to = np.lexsort((x[2, by], where))
    x = x.take(by[to], axis=1)
    same = np.concatenate([[False], (x[0, 1:] == x[0, :-1]) & (x[1, 1:] == x[1, :-1]) & (x[2, 1:] == x[2, :-1])])
    if same.any():
        own = np.cumsum(~same)
        again = np.flatnonzero(same | np.append(same[1:], False))
        to = again[np.lexsort((x[4, again], x[3, again], own[again]))]
        x[:, again] = x[:, to]
        x = x[:, ~same]
    return x


def meet(t: float):
    """PACKS dealt and sorted by bucket: MET, pairs to verify with a null key, and rows of crowds (b, b_doc, b_number, key, shape, crowded)."""
    names = [c.split()[0] for c in MET.split(", ")]

    def told(x, part):
        """part: x is of groups that are too large to hold; all of them is crowded."""
        if not x.shape[1]:
            return
        a, b, crowded, crowd = _compared(x, t)
        if part:
            crowded[:], crowd[:] = True, True
        whole = x[2:, b]
        if len(a):
            by = np.lexsort((x[2, b], x[2, a]))
            new = np.concatenate([[True], (np.diff(x[2, a[by]]) != 0) | (np.diff(x[2, b[by]]) != 0)])
            a, b = a[by[new]], b[by[new]]
            whole = x[2:, b]
            null = pa.nulls(len(a), pa.int64())
            arrays = [x[2, a], whole[0], x[3, a], x[4, a].astype(np.int32), whole[1], whole[2].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), null, null, pa.nulls(len(a), pa.bool_())], names)
        if crowd.any():
            n, y = int(crowd.sum()), x[:, crowd]
            arrays = [pa.nulls(n, pa.int64()), y[2], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), y[3], y[4].astype(np.int32), y[0], y[1], crowded[crowd]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in arrays], names)

    def ended(waiting, long):
        """Of whole buckets; long: the keys of groups that were told in part."""
        x = np.concatenate(waiting, axis=1)
        if len(long):
            part = np.isin(x[0], long)
            yield from told(_ordered(x[:, part], True), True)
            x = x[:, ~part]
        yield from told(_ordered(x, False), False)

    def run(batches):
        none = np.zeros(0, np.int64)
        waiting, rows, most, long, bucket = [], 0, HELD, none, None
        for b in batches:
            for new, pack in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if new != bucket and rows >= AT_ONCE:
                    yield from ended(waiting, long)
                    waiting, rows, most, long = [], 0, HELD, none
                bucket = new
                waiting.append(np.frombuffer(pack.as_buffer(), np.int64).reshape(COLUMNS, -1))
                rows += waiting[-1].shape[1]
                if rows > most:
                    x = _ordered(np.concatenate(waiting, axis=1), True)
                    large = (_runs(x[0]) > HELD // 4) | np.isin(x[0], long)
                    if x.shape[1] > HELD // 2 and large.any():
                        yield from told(x[:, large], True)
                        long = np.union1d(long, x[0, large])
                        x = x[:, ~large]
                    waiting, rows = [x], x.shape[1]
                    most = max(HELD, 2 * rows)  # other groups are small: a bucket has few more rows than BUCKET of them
        if rows:
            yield from ended(waiting, long)

    return run


def marks(values: DataFrame) -> np.ndarray:
    """A filter of FILTER bits by the low parts of the values (s)."""
    slot = F.col("s").bitwiseAND(F.lit(FILTER - 1))
    bits = values.select(F.shiftright(slot, 5).alias("k"), F.expr("shiftleft(1L, cast(s & 31 AS int))").alias("bit")).groupBy("k").agg(F.bit_or("bit").alias("bit"))
    out = np.zeros(FILTER // 32, np.uint32)
    for part in bits.toArrow().to_batches():  # FILTER / 32 rows at most
        out[part.column(0).to_numpy()] = part.column(1).to_numpy().astype(np.uint32)
    return out


def marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values.view(np.uint64) & np.uint64(FILTER - 1)
    return (bits[(low >> np.uint64(5)).astype(np.int64)] >> (low & np.uint64(31)).astype(np.uint32)) & 1 > 0
