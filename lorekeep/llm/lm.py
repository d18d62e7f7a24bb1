"""Language-model scores by a hierarchical Pitman-Yor model.

Every token is a customer in the restaurant of the word before it; every word that comes before another, and the start of
a text, has a restaurant of its own, and every word is a dish. The parent of all of them is a restaurant over words, whose
customers are the leaves' tables. Seatings are sampled by Gibbs: given x ~ Gamma(strength / discount + tables) of a
restaurant its dishes are independent, and the tables of each are drawn from their law given its customers, which is that
of the seatings of a Chinese restaurant. The chain runs leaves, root, leaves, each a few sweeps given the other level; predictive probabilities are averaged over the sweeps after the burn-in.

Counts of (context, word) are dealt by context into buckets of bounded size, so contexts and dishes grow with the corpus. Restaurants
of very frequent words are dealt by dish as well, each share taking its own tables, times the shares, for the whole. The
counts of the LOCAL most frequent words and pairs are broadcast: tokens of such pairs are priced where they are read. All
other tokens go to their context; those of rarer words get their word's probability in a join before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import LOWER, Words, crc_mod, mixed, release, slices, starts_of, stored, texts_of

#: Words, and pairs of context and word, whose statistics are broadcast, at most.
LOCAL = 1 << 18
BURN_IN, SWEEPS = 2, 4
STRENGTH = 1.0
#: Discount of the first leaf sweeps; later ones take it from the counts.
DISCOUNT = 0.75
#: Tokens of a context that go to one share, and tokens that are seated at once, about; bytes of text read at once.
SHARE, BUCKET, SLICE = 1 << 18, 1 << 20, 8 << 20
#: Documents whose sums are gathered in one place, about.
BLOCK = 1 << 14
#: A pair may be among the most frequent from so many uses on, and from this part of all tokens on.
FREQUENT, PART = 8, 1 << 24
#: The hashes that stand for the end of a text and for its start.
END = xxhash.xxh3_64_intdigest(b"\n end") - (1 << 63)
START = xxhash.xxh3_64_intdigest(b"\n start") - (1 << 63)
#: Customers of a dish up to which the law of its tables is tabulated.
EXACT = 512
#: Customers of a dish up to which its columns are drawn as whole arrays; rows of the root that are seated at once, at least.
FEW, ROWS = 16, 1 << 17
SEATED = "kind int, word long, context long, n long, tables double, own double, back double"
NEAR = "id long, doc_id long, salt int, held_out boolean, n_tokens long, n_known long, base double, score double, far long, words array<long>, contexts array<long>"


def _order(key: np.ndarray) -> np.ndarray:
    """np.argsort(key, kind="stable") of values from 0 on: places are sorted as the last bits of their values, where they fit."""
    bits = len(key).bit_length()
    if len(key) and int(key.max()) >> (63 - bits):
        return np.argsort(key, kind="stable")
    return np.sort((key.astype(np.int64) << bits) | np.arange(len(key))) & ((1 << bits) - 1)


def _gathered(batches, text: int = 1):
    """Texts of about SLICE bytes at once, of small batches and of large ones: what is done once for each slice is done seldom."""
    held, size = [], 0
    for b in slices(batches, text=text, limit=SLICE):
        more = b.column(text).nbytes
        if held and size + more > SLICE:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += more
    if held:
        yield pa.concat_batches(held)


def _rows(batches, least: int):
    """Batches of that many rows at least, but the last."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if size:
        yield pa.concat_batches(held)


def _tokens(column: pa.Array):
    """Per token, ends included: codes of the word before it and of its own; tokens of each text; and the hashes by code, START last."""
    found = Words(texts_of(column, LOWER))
    n = found.counts + 1
    token = np.full(n.sum(), END)
    token[np.arange(len(found.row)) + found.row] = found.hashes().view(np.int64)
    token, words = pd.factorize(token)
    before = np.empty(len(token), np.int64)
    before[1:] = token[:-1]
    before[starts_of(n)[:-1]] = len(words)
    return before, token, n, np.append(words, START)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.91893853320467274 + (1 / 12 - (1 / 360 - 1 / 1260 / y**2) / y**2) / y
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    """A number from 0 to 1 for each key and step, the same each time: a task that runs again draws the same seating."""
    return (mixed(key.view(np.uint64) + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)) * 2.0**-53


class Tables:
    """Draws of the tables of dishes: n customers have t with weight S_d(n, t) a^t, S_d generalised Stirling numbers.

    Up to EXACT customers the law itself is drawn from. Beyond, the first EXACT are drawn by it, weighted for those that
    follow, and the others open tables as they come, in blocks in which their number is all but constant.
    """

    def __init__(self, d: float):
        self.d, t = d, np.arange(EXACT + 1)
        self.log = np.full((EXACT + 1, EXACT + 1), -np.inf)
        self.log[1, 1] = 0.0
        with np.errstate(divide="ignore"):
            for n in range(1, EXACT):
                joined = self.log[n] + np.log(np.maximum(n - d * t, 0))
                self.log[n + 1] = np.logaddexp(joined, np.concatenate([[-np.inf], self.log[n, :-1]]))

    def _pick(self, weights: np.ndarray, u: np.ndarray) -> np.ndarray:
        """A column of each row of log weights; columns count from 1."""
        below = np.exp(weights - weights.max(axis=1, keepdims=True)).cumsum(axis=1)
        return 1.0 + (below < (u * below[:, -1])[:, None]).sum(axis=1)

    def _few(self, n: np.ndarray, a: np.ndarray, u: np.ndarray, widest: int) -> np.ndarray:
        """As _pick, of n customers, few: columns are whole arrays."""
        log_a = np.log(a)
        weights = [self.log[:, t][n] + log_a * t for t in range(1, widest + 1)]
        most = np.maximum.reduce(weights)
        below = [np.exp(weights[0] - most)]
        for w in weights[1:]:
            below.append(below[-1] + np.exp(w - most))
        u, out = u * below[-1], np.ones(len(n))
        for x in below[:-1]:
            out += x < u
        return out

    def draw(self, n: np.ndarray, a: np.ndarray, key: np.ndarray, step: int) -> np.ndarray:
        order = _order(n)
        sizes, out = n[order], np.ones(len(n))
        at = int(np.searchsorted(sizes, 2))
        small = int(np.searchsorted(sizes, EXACT, "right"))
        while at < small:
            widest = min(max(int(sizes[at]), int(sizes[at] * 1.25)), EXACT)
            to = min(int(np.searchsorted(sizes, widest, "right")), at + max(1, (1 << 22 if widest > FEW else 1 << 17) // widest))
            i = order[at:to]
            widest = int(sizes[to - 1])
            if widest <= FEW:
                out[i], at = self._few(sizes[at:to], a[i], _uniform(key[i], step), widest), to
                continue
            weights = self.log[n[i], 1 : widest + 1] + np.log(a[i])[:, None] * np.arange(1, widest + 1)
            out[i] = self._pick(weights, _uniform(key[i], step))
            at = to
        for at in range(small, len(n), 1 << 12):
            i = order[at : at + (1 << 12)]
            out[i] = self._many(n[i].astype(float), a[i], key[i], step)
        return out

    def _many(self, n, a, key, step):
        d, t = self.d, np.arange(1, EXACT + 1)
        spare = a[:, None] - d * t
        follow = _log_gamma(n[:, None] + spare) - _log_gamma(EXACT + spare)
        tables, k = self._pick(self.log[EXACT, 1:] + np.log(a)[:, None] * t + follow, _uniform(key, step)), float(EXACT)
        rng = np.random.default_rng([step, int(key[0]) % (1 << 63)])
        while k < n.max():
            to = np.maximum(np.minimum(np.floor(k * 1.25), n), k)
            weight = a * ((k * 1.12 + a) / (n + a)) ** d
            low = k - d * tables + weight
            tables = tables + np.minimum(rng.poisson(weight * np.log((to - k + low) / low)), to - k)
            k = np.floor(k * 1.25)
        return tables


def seat_leaves(group, n, root, share, spare, total, law: Tables, key, rng: np.random.Generator):
    """(tables in the last sweep, mean tables, own, back) of each dish: its probability is own + back * the root's, a mean over sweeps.

    group: the dish's restaurant, from 0; of each restaurant: share, the parts that its dishes are dealt to, spare, tables
    of dishes that are seated elsewhere, and total, all its customers.
    """
    t, mean, mean_all = (n > 0).astype(float), np.zeros(len(n)), np.zeros(len(share))
    many, d = np.flatnonzero(n > 1), law.d
    many = many[_order(n[many])]
    n_many, group_many, root_many, key_many = n[many], group[many], root[many], key[many]
    of = lambda t: spare + share * np.bincount(group, t, len(share))
    all_of = of(t)
    for sweep in range(BURN_IN + SWEEPS):
        x = rng.gamma(STRENGTH / d + all_of)
        t[many] = law.draw(n_many, d * np.maximum(x[group_many] * root_many, 1e-300), key_many, sweep)
        all_of = of(t)
        if sweep >= BURN_IN:
            mean += t / SWEEPS
            mean_all += all_of / SWEEPS
    return t, mean, (n - d * mean) / (STRENGTH + total)[group], ((STRENGTH + d * mean_all) / (STRENGTH + total))[group]


class Top:
    """The most frequent words: hashes, in order, their training tokens and, once known, their probabilities in the root.

    A context's tokens are those of its word; spare: tables of the pairs that are priced where they are read.
    """

    def __init__(self, words: np.ndarray, times: np.ndarray, total: int, distinct: int):
        by = np.argsort(words)
        self.words, self.times, self.total, self.distinct = words[by], times[by], total, distinct
        tokens = np.where(self.words == START, 0, self.times)
        self.root = np.maximum(tokens, 0.5) / max(total, 1)
        self.other = max(total - int(tokens.sum()), 1) / max(distinct - len(words), 1) / max(total, 1)
        self.spare = np.zeros(len(words))
        self.places = pd.Index(self.words)

    def index(self, h: np.ndarray) -> np.ndarray:
        """The place of each word, or -1."""
        return self.places.get_indexer(h)

    def take(self, values: np.ndarray, at: np.ndarray, other):
        return np.where(at >= 0, values[at], other) if len(values) else np.full(len(at), other)

    def share(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The share of a context that a dish is dealt to; context: places among the top words, or -1; word: hashes."""
        many = 1 + self.take(self.times, context, 0).astype(np.int64) // SHARE
        out = np.zeros(len(context), np.int64)
        large = np.flatnonzero(many > 1)
        out[large] = (mixed(word[large].view(np.uint64)) % many[large].astype(np.uint64)).astype(np.int64)
        return out

    def shares(self, context: np.ndarray) -> np.ndarray:
        return 1 + self.take(self.times, context, 0).astype(np.int64) // SHARE


def _bucket(context: np.ndarray, share: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(context.view(np.uint64) + share.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _packed(top: Top, buckets: int, words: np.ndarray, at: np.ndarray, context: np.ndarray, word: np.ndarray, **each: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket, of runs of equal contexts and their words; frequent words by their places among the top ones.

    words, at: by code, hashes and places among the top ones, or -1; context, word: codes. each: more values of each token,
    among them doc, the place of its document; ids and salts name the documents.
    """
    ids, salts = each.pop("ids", None), each.pop("salts", None)
    bucket = _bucket(words, np.zeros(len(words), np.int64), buckets)[context]
    dealt = np.flatnonzero((top.shares(at) > 1)[context])
    if len(dealt):
        hot, of = context[dealt], words[word[dealt]]
        bucket[dealt] = _bucket(words[hot], top.share(at[hot], of), buckets)
    by = _order(bucket * len(words) + context)
    bucket, codes, word = bucket[by], context[by], word[by]
    word_at = at[word]
    edge = np.flatnonzero(np.diff(bucket)) + 1
    begin = np.concatenate([[0], edge]).astype(np.int64)
    run = np.flatnonzero(np.concatenate([[True], (np.diff(codes) != 0) | (np.diff(bucket) != 0)]))
    of_run, names, ends = bucket[run], bucket[begin], np.append(begin, len(bucket))
    context_at = at[codes[run]]

    def listed(values, of):
        """values of tokens or runs that are in the buckets of, in order."""
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.append(names, buckets)).astype(np.int32)), pa.array(values))

    rare_run, rare = np.flatnonzero(context_at < 0), np.flatnonzero(word_at < 0)
    columns = {
        "bucket": pa.array(names),
        "context_at": listed(context_at.astype(np.int32), of_run),
        "context": listed(words[codes[run[rare_run]]], of_run[rare_run]),
        "run": listed(np.diff(np.append(run, len(bucket))).astype(np.int32), of_run),
        "word_at": listed(word_at.astype(np.int32), bucket),
        "word": listed(words[word[rare]], bucket[rare]),
    }
    if ids is not None:
        # The documents of each bucket, in order, and the place of each token's among them.
        row = np.repeat(np.arange(len(names)), np.diff(ends))
        key = row * len(ids) + each.pop("doc")[by]
        sort = _order(key)
        first = np.concatenate([[True], np.diff(key[sort]) != 0])
        own = key[sort[first]]
        told = np.searchsorted(own, np.arange(len(names) + 1) * len(ids))
        place = np.empty(len(key), np.int64)
        place[sort] = np.cumsum(first) - 1
        place -= told[row]
        places = [place[i:j].astype(np.uint16 if n <= 1 << 16 else np.uint32).tobytes() for i, j, n in zip(ends[:-1].tolist(), ends[1:].tolist(), np.diff(told).tolist(), strict=True)]
        at, own = pa.array(told.astype(np.int32)), own % len(ids)
        columns |= {"doc": pa.array(places, pa.binary()), "ids": pa.ListArray.from_arrays(at, pa.array(ids[own])), "salts": pa.ListArray.from_arrays(at, pa.array(salts[own]))}
    columns |= {k: listed(v[by], bucket) for k, v in each.items()}
    return pa.RecordBatch.from_pydict(columns)


PACKED = "bucket long, context_at array<int>, context array<long>, run array<int>, word_at array<int>, word array<long>"
SUMMED = ["id", "salt", "times", "score"]
SUMS = "block long, id array<long>, salt array<int>, times array<long>, score array<double>"
TOKENS = PACKED + ", doc binary, ids array<long>, salts array<int>, root array<double>"


def _counted(batches):
    """(word, n): training tokens in a slice."""
    for b in _gathered(batches, text=0):
        _, token, n, words = _tokens(b.column(0))
        times = np.bincount(token[np.repeat(b.column(1).to_numpy(zero_copy_only=False), n)], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(words[times > 0]), pa.array(times[times > 0])], ["word", "n"])


def _pairs(top: Top, buckets: int):
    """PACKED with times: training tokens of each pair in a slice."""

    def run(batches):
        for b in _gathered(batches, text=0):
            before, token, n, words = _tokens(b.column(0))
            trained = np.repeat(b.column(1).to_numpy(zero_copy_only=False), n)
            pair, times = np.unique((before * len(words) + token)[trained], return_counts=True)
            if len(pair):
                yield _packed(top, buckets, words, top.index(words), pair // len(words), pair % len(words), times=times.astype(np.int32))

    return run


def _buckets(batches):
    """The rows of each bucket, of rows sorted by bucket."""
    held = []
    for b in batches:
        bucket = b.column(0).to_numpy()
        ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
        for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if i < j:
                if held and held[0].column(0)[0].as_py() != bucket[i]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _flat(rows: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in rows[name].chunks])


def _known(at: np.ndarray, rare: np.ndarray, top: Top):
    """A code for each place among the top words, and for each hash that stands where the place is -1; and the hashes by code."""
    codes, hashes = pd.factorize(rare)
    out = at.astype(np.int64)
    out[at < 0] = codes + len(top.words)
    return out, np.concatenate([top.words, hashes])


class Dishes:
    """The distinct dishes of a bucket's rows: per token its dish, and per dish its restaurant (a context's share) and word."""

    def __init__(self, rows: pa.Table, top: Top):
        run, self.at = _flat(rows, "run"), _flat(rows, "word_at")
        code, contexts = _known(_flat(rows, "context_at"), _flat(rows, "context"), top)
        used = np.flatnonzero(np.bincount(code, minlength=len(contexts)))
        used = used[np.argsort(contexts[used])]
        rank = np.zeros(len(contexts), np.int64)
        rank[used] = np.arange(len(used))
        contexts = contexts[used]
        word, named = _known(self.at, _flat(rows, "word"), top)
        pair = np.repeat(rank[code], run) * len(named) + word
        by = _order(pair)
        sorted_pair = pair[by]
        first = np.ones(len(by), bool)
        first[1:] = sorted_pair[1:] != sorted_pair[:-1]
        self.item = np.empty(len(by), np.int64)
        self.item[by] = np.cumsum(first) - 1
        self.first = by[first]
        context = sorted_pair[first] // len(named)
        self.word, self.context = named[word[self.first]], contexts[context]
        places = top.index(contexts)
        self.group, self.contexts = context, contexts
        if (top.shares(places) > 1).any():
            share = top.share(places[context], self.word)
            of, self.group = np.unique(context * (share.max(initial=0) + 1) + share, return_inverse=True)
            self.contexts = contexts[of // (share.max(initial=0) + 1)]
        self.seed = int(rows["bucket"][0].as_py())

    def seat(self, n: np.ndarray, root: np.ndarray, top: Top, law: Tables):
        at = top.index(self.contexts)
        total = top.take(top.times, at, 0) + np.where(at < 0, np.bincount(self.group, n, len(self.contexts)), 0)
        key = mixed(mixed(self.context.view(np.uint64)) + self.word.view(np.uint64)).view(np.int64)
        return seat_leaves(self.group, n, root, top.shares(at), top.take(top.spare, at, 0.0), total, law, key, np.random.default_rng(self.seed))


def _first_leaves(top: Top, least: int):
    """SEATED of training pairs: (word, tables) of each word (0), the most frequent pairs (1), pairs that come once and twice (2)."""

    def run(batches):
        law = Tables(DISCOUNT)
        for rows in _buckets(batches):
            x = Dishes(rows, top)
            n = np.bincount(x.item, _flat(rows, "times"), len(x.word)).astype(np.int64)
            last, tables, own, back = x.seat(n, top.take(top.root, x.at[x.first], top.other), top, law)
            codes, words = pd.factorize(x.word)
            often = np.flatnonzero(n >= least)
            kind = np.repeat([0, 1, 2], [len(words), len(often), 1]).astype(np.int32)
            fill = np.zeros(len(words))
            whole = lambda a, b, c: pa.array(np.concatenate([a, b, [c]]))
            zero = fill.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), whole(words, x.word[often], 0), whole(zero, x.context[often], 0), whole(zero, n[often], (n == 1).sum()), whole(np.bincount(codes, last, len(words)), tables[often], float((n == 2).sum())), whole(fill, own[often], 0.0), whole(fill, back[often], 0.0)],
                [c.split()[0] for c in SEATED.split(", ")],
            )

    return run


class Pairs:
    """The pairs of context and word that are priced where they are read: places of both among the top words, and log10 of the probability."""

    def __init__(self, context: np.ndarray, word: np.ndarray, score: np.ndarray):
        self.key, self.score = pd.Index(context << 32 | word), score

    def index(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of each pair, or -1."""
        out = np.full(len(context), -1)
        if len(self.key):
            some = np.flatnonzero((context >= 0) & (word >= 0))
            out[some] = self.key.get_indexer(context[some] << 32 | word[some])
        return out


def _placed(column: pa.Array, top: Top, pairs: Pairs):
    """What _tokens tells; by code, places among the top words; and the place of each token's pair."""
    before, token, n, words = _tokens(column)
    at = top.index(words)
    return before, token, n, words, at, pairs.index(at[before], at[token])


def _near(top: Top, pairs: Pairs):
    """NEAR: what is known of each document from broadcast statistics; far counts its tokens in other pairs, words and contexts list the rarer words among them."""

    def run(batches):
        for b in _gathered(batches):
            before, token, n, words, at, pair = _placed(b.column(1), top, pairs)
            begin, row = starts_of(n), np.repeat(np.arange(len(n)), n)
            sums = lambda x: np.add.reduceat(x, begin[:-1])  # noqa: E731  every text has an end
            known = (at >= 0)[token]
            base = np.where(at >= 0, np.log10(top.take(top.times, at, 0) + 1.0), 0.0)[token]
            score = np.where(pair >= 0, pairs.score[pair], 0.0) if len(pairs.key) else np.zeros(len(token))
            rare = np.flatnonzero(~known)
            lists = pa.array(starts_of(np.bincount(row[rare], minlength=len(n))).astype(np.int32))
            arrays = [pa.array(n), pa.array(sums(known.astype(np.int64))), pa.array(sums(base)), pa.array(sums(score)), pa.array(sums((pair < 0).astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), b.column(2), b.column(3), *arrays, pa.ListArray.from_arrays(lists, pa.array(words[token[rare]])), pa.ListArray.from_arrays(lists, pa.array(words[before[rare]]))], [c.split()[0] for c in NEAR.split(", ")])

    return run


def _far(top: Top, pairs: Pairs, buckets: int):
    """TOKENS of frequent words in other pairs."""

    def run(batches):
        for b in _gathered(batches):
            before, token, n, words, at, pair = _placed(b.column(1), top, pairs)
            far = np.flatnonzero((pair < 0) & (at >= 0)[token])
            if len(far):
                doc = np.repeat(np.arange(len(n)), n)[far]
                out = _packed(top, buckets, words, at, before[far], token[far], doc=doc, ids=b.column(0).to_numpy(), salts=b.column(2).to_numpy())
                none = pa.ListArray.from_arrays(pa.array(np.zeros(out.num_rows + 1, np.int32)), pa.array([], pa.float64()))
                yield out.append_column("root", none)

    return run


def _rare(top: Top, buckets: int):
    """TOKENS of rarer words, which bring their probabilities in the root."""

    def run(batches):
        for b in _rows(batches, SHARE):
            key, salt, word, context, root = (b.column(k).to_numpy() for k in range(5))
            codes, words = pd.factorize(np.concatenate([context, word]))
            yield _packed(top, buckets, words, top.index(words), codes[: len(key)], codes[len(key) :], doc=np.arange(len(key)), ids=key, salts=salt, root=root)

    return run


def _last_leaves(top: Top, d: float, blocks: int):
    """SUMS over the tokens of a bucket: a row for each block of documents."""

    def run(batches):
        law = Tables(d)
        for rows in _buckets(batches):
            x = Dishes(rows, top)
            places, sizes = [], np.concatenate([c.value_lengths().to_numpy() for c in rows["word_at"].chunks])
            base, told = 0, np.concatenate([c.value_lengths().to_numpy() for c in rows["ids"].chunks])
            for blob, size, many in zip(rows["doc"].to_pylist(), sizes.tolist(), told.tolist(), strict=True):
                places.append(np.frombuffer(blob, np.uint16 if len(blob) == 2 * size else np.uint32).astype(np.int64) + base)
                base += many
            doc = np.concatenate(places)
            names = pd.DataFrame({"id": _flat(rows, "ids"), "salt": _flat(rows, "salts")})
            n = np.bincount(x.item, names["salt"].to_numpy()[doc] & 1, len(x.word)).astype(np.int64)
            at, given = x.at[x.first], np.zeros(len(x.item))
            brings = np.concatenate([c.value_lengths().to_numpy() for c in rows["root"].chunks]) > 0
            given[np.repeat(brings, sizes)] = _flat(rows, "root")
            root = np.where(at >= 0, top.take(top.root, at, 0.0), given[x.first])
            _, _, own, back = x.seat(n, root, top, law)
            price = np.log10(own + back * root)[x.item]
            names["times"], names["score"] = np.bincount(doc, minlength=base), np.bincount(doc, price, base)
            out = names.groupby(["id", "salt"], as_index=False).sum()
            block = (mixed(out["id"].to_numpy().view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            by = np.argsort(block, kind="stable")
            some, begin = np.unique(block[by], return_index=True)
            at = pa.array(np.append(begin, len(by)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.ListArray.from_arrays(at, pa.array(out[c].to_numpy()[by])) for c in SUMMED)], ["block", *SUMMED])

    return run


def _by_document(batches):
    """(id, salt, times, score) of the documents of each block, of SUMS sorted by block."""

    def summed(parts):
        return pd.concat(parts).groupby(["id", "salt"], as_index=False).sum()

    for rows in _buckets(batches):
        parts, size = [], 0
        for k in range(rows.num_rows):
            parts.append(pd.DataFrame({c: rows[c][k].values.to_numpy() for c in SUMMED}))
            size += len(parts[-1])
            if size > 1 << 20:
                parts, size = [summed(parts)], 0
        yield pa.RecordBatch.from_pandas(summed(parts), preserve_index=False)


def discount_of(one: float, two: float) -> float:
    return float(np.clip((one + 1) / (one + 2 * two + 2), 0.1, 0.95))


def root_tables(n: np.ndarray, key: np.ndarray, x: float, base: float, law: Tables, sweep: int) -> np.ndarray:
    """Tables of each word in the root in a sweep, given its x."""
    t, many = (n > 0).astype(float), np.flatnonzero(n > 1)
    t[many] = law.draw(n[many], np.full(len(many), law.d * x * base), key[many], sweep)
    return t


def root_of(words: DataFrame, distinct: int, seed: int = 2) -> DataFrame:
    """words (word, times, customers) with the averaged probability of each in the root: (word, times, root); and that of a word never seen.

    Each sweep draws x from all tables of the one before, and the tables of each word given x.
    """
    total, kinds, one, two = words.agg(F.sum("customers"), *[F.count_if(F.expr(c)) for c in ("customers > 0", "customers = 1", "customers = 2")]).first()
    total, base, d = float(total or 0), 1 / (distinct + 1), discount_of(one, two)
    rng, xs, tables = np.random.default_rng(seed), [], [float(kinds)]

    def counted(sweep, x):
        def run(batches):
            law = Tables(d)
            for b in _rows(batches, ROWS):
                t = root_tables(b.column(1).to_numpy(), b.column(0).to_numpy(), x, base, law, sweep)
                yield pa.RecordBatch.from_arrays([pa.array([float(t.sum())])], ["tables"])

        return run

    several = words.filter("customers > 1").select("word", "customers")
    for sweep in range(BURN_IN + SWEEPS):
        xs.append(float(rng.gamma(STRENGTH / d + tables[-1])))
        tables.append(one + float(several.mapInArrow(counted(sweep, xs[-1]), "tables double").agg(F.sum("tables")).first()[0] or 0.0))
    spare = np.array([STRENGTH + d * t for t in tables[1 + BURN_IN :]]).mean() * base / (STRENGTH + total)

    def priced(batches):
        law = Tables(d)
        for b in _rows(batches, ROWS):
            n, key = b.column(2).to_numpy(), b.column(0).to_numpy()
            t = np.mean([root_tables(n, key, xs[k], base, law, k) for k in range(BURN_IN, BURN_IN + SWEEPS)], axis=0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((n - d * t) / (STRENGTH + total) + spare)], ["word", "times", "root"])

    return words.select("word", "times", "customers").mapInArrow(priced, "word long, times long, root double"), float(spare)


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document row.

    Learns from rows whose crc32 of doc_id mod 7 is not 2. A null text is empty: one end token. Without training rows all
    probabilities are 1. Repeated rows keep a row each, and each counts in training; rows of one doc_id with other texts
    are told apart by 30 bits of the text's hash. Extra columns are ignored; an empty table gives an empty result. A word
    is known by a 64-bit hash.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (crc_mod("doc_id", 7) != 2).alias("train"))
    counts = stored(docs.select("text", "train").mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("times")))
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("times"), F.count("*")).first())
    trained = docs.filter("train").count()
    most = counts.orderBy(F.desc("times"), "word").limit(LOCAL).toArrow()
    top = Top(np.append(most.column("word").to_numpy(), START), np.append(most.column("times").to_numpy(), trained), total, distinct)

    pairs = _by_bucket(docs.select("text", "train").mapInArrow(_pairs(top, 1 + total // BUCKET), PACKED + ", times array<int>"))
    least = max(FREQUENT, total // PART)
    seated = stored(pairs.mapInArrow(_first_leaves(top, least), SEATED))
    one, two = seated.filter("kind = 2").agg(F.sum("n"), F.sum("tables")).first()
    d = discount_of(one or 0, two or 0)
    customers = seated.filter("kind = 0").groupBy("word").agg(F.sum("tables").cast("long").alias("customers"))
    both = stored(counts.join(customers, "word"))
    release(counts)
    priced, never = root_of(both, distinct)
    roots = stored(priced)
    release(both)
    found = roots.orderBy(F.desc("times"), "word").limit(LOCAL).toArrow()
    top.root[top.index(found.column("word").to_numpy())] = found.column("root").to_numpy()
    rarest = int(found.column("times").to_numpy().min(initial=total))

    often = seated.filter("kind = 1").orderBy(F.desc("n"), "context", "word").limit(LOCAL).toArrow()
    context, word = (top.index(often.column(c).to_numpy()) for c in ("context", "word"))
    use = (context >= 0) & (word >= 0)
    context, word = context[use], word[use]
    n, tables, back = (often.column(c).to_numpy()[use] for c in ("n", "tables", "back"))
    own = (n - d * tables) / (STRENGTH + top.times[context])
    back = (STRENGTH + d * (back * (STRENGTH + top.times[context]) - STRENGTH) / DISCOUNT) / (STRENGTH + top.times[context])
    local = Pairs(context, word, np.log10(own + back * top.root[word]))
    top.spare = np.bincount(context, tables, len(top.words))
    release(seated)

    salt = F.shiftleft(F.shiftright(F.xxhash64("text"), 34).cast("int"), 1).bitwiseOR(F.col("train").cast("int")).alias("salt")
    keyed = docs.select(F.coalesce("doc_id", F.xxhash64("text")).alias("id"), "text", salt, (~F.col("train")).alias("held_out"), "doc_id")
    near = stored(keyed.mapInArrow(_near(top, local), NEAR))
    listed = near.select("id", "salt", F.explode(F.arrays_zip("words", "contexts")).alias("x")).select("id", "salt", F.col("x.words").alias("word"), F.col("x.contexts").alias("context"))
    rare = listed.join(roots.filter(F.col("times") <= rarest), "word", "left")
    rare = stored(rare.select("id", "salt", "word", "context", F.coalesce("root", F.lit(never)).alias("root"), F.coalesce("times", F.lit(0)).alias("times")))
    buckets = 1 + int(near.agg(F.sum("far")).first()[0] or 0) // BUCKET
    tokens = keyed.select("id", "text", "salt").mapInArrow(_far(top, local, buckets), TOKENS).unionByName(rare.drop("times").mapInArrow(_rare(top, buckets), TOKENS))
    sums = _by_bucket(tokens).mapInArrow(_last_leaves(top, d, 1 + near.count() // BLOCK), SUMS)
    met = sums.repartition("block").sortWithinPartitions("block").mapInArrow(_by_document, "id long, salt int, times long, score double")
    met = stored(met.select("id", "salt", F.col("times").alias("far_times"), F.col("score").alias("far_score")))
    known = rare.groupBy("id", "salt").agg(F.count("*").alias("rare_times"), F.count_if(F.col("times") > 0).alias("rare_known"), F.sum(F.log10(F.col("times") + 1.0)).alias("rare_base"))
    out = near.join(met, ["id", "salt"], "left").join(known, ["id", "salt"], "left")
    # Equal rows met their tokens together: each takes its share.
    part = F.when(F.col("far") > 0, F.col("far") / F.col("far_times")).otherwise(0.0)
    rare_part = F.when(F.size("words") > 0, F.size("words") / F.col("rare_times")).otherwise(0.0)
    add = lambda c, part: F.coalesce(F.col(c) * part, F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.round(add("rare_known", rare_part)).cast("long")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + add("rare_base", rare_part) - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        (F.col("score") + add("far_score", part)).alias("score"),
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, perplexity, base_perplexity): a token's, over all documents of each kind."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))
