"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents. Word, prefix and suffix features whose documents are toxic beyond chance are seeds; a word of a
toxic document that carries a seed is labelled 1, every other word 0, and the field is trained on these labelled tokens.
Only words with a feature of some positive word, the active ones, have emissions of their own. The field is fitted on
windows of MARGIN words around the active words of the sample, and tags whole texts: forward-backward goes from one active
word to the next, over the run of other words between them by a power of their common transition. That gives each word's
probability of being toxic; the document's score is a logistic function of the noisy-or of its active words, fitted to the
labels; words of probability 0.5 or more are the offending offsets.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import crc_mod, slices, starts_of, texts_of, tokens

#: Labelled documents to fit on, of each class at most; taken by a hash of doc_id.
SAMPLE = 1000
AFFIXES = range(3, 7)
MARGIN = 12
REJECT = 0.7
#: ASCII letters and all that is not ASCII make words.
LETTERS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCORES = "doc_id long, score double, span_from array<int>, span_to array<int>"


def features(word: str) -> list[str]:
    n = len(word)
    return ["=" + word, *("^" + word[:k] for k in AFFIXES if k <= n), *(word[-k:] + "$" for k in AFFIXES if k <= n)]


def words_of(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(place of each word among the different words, those words, words of each text)."""
    flat, counts = tokens(pc.utf8_lower(texts_of(column, LETTERS)))
    d = flat.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary, counts


class Chain:
    """Windows of words: `active` words, and up to MARGIN others on either side."""

    def __init__(self, active: np.ndarray, row: np.ndarray):
        near = np.zeros(len(active), bool)
        at = np.flatnonzero(active)
        for d in range(-MARGIN, MARGIN + 1):
            p = at + d
            ok = (p >= 0) & (p < len(active))
            near[p[ok][row[p[ok]] == row[at[ok]]]] = True
        self.at = np.flatnonzero(near)
        first = np.ones(len(self.at), bool)
        first[1:] = (np.diff(self.at) > 1) | (np.diff(row[self.at]) > 0)
        begin = np.flatnonzero(first)
        size = np.diff(np.concatenate([begin, [len(self.at)]]))
        self.step = np.arange(len(self.at)) - np.repeat(begin, size)
        # Longest first, so that at each step the windows that go on are a prefix of all.
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(size), np.int64)
        place[order] = np.arange(len(size))
        self.chain, self.longest = np.repeat(place, size), int(size.max(initial=0))
        by = np.argsort(self.step, kind="stable")
        self.steps = np.split(by[np.lexsort((self.chain[by], self.step[by]))], np.cumsum(np.bincount(self.step, minlength=self.longest))[:-1]) if len(by) else []

    def marginals(self, score: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(tag 1) of each word of the windows, and the expected transitions; score: of tag 1 against 0."""
        p, pairs = np.zeros(len(self.at)), np.zeros((2, 2))
        if not self.steps:
            return p, pairs
        psi = np.exp(trans)
        emit = np.exp(np.stack([np.minimum(0, -score), np.minimum(0, score)], axis=1))  # scaled: each row's most is 1
        forward, alpha = [], None
        for s in self.steps:
            alpha = emit[s] if alpha is None else (alpha[: len(s)] @ psi) * emit[s]
            alpha = alpha / alpha.sum(axis=1, keepdims=True)
            forward.append(alpha)
        beta = np.ones((len(self.steps[-1]), 2))
        for k in range(len(self.steps) - 1, -1, -1):
            s = self.steps[k]
            beta = np.concatenate([beta, np.ones((len(s) - len(beta), 2))])
            both = forward[k] * beta
            p[s] = both[:, 1] / both.sum(axis=1)
            if k:
                right = emit[s] * beta
                joint = forward[k - 1][: len(s), :, None] * psi[None] * right[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                beta = right @ psi.T
                beta = beta / beta.sum(axis=1, keepdims=True)
        return p, pairs


class Powers:
    """Powers of a positive 2 x 2 matrix, each over that of its larger eigenvalue."""

    def __init__(self, m: np.ndarray):
        half, det = m.trace() / 2, np.linalg.det(m)
        root = np.sqrt(max(half * half - det, 1e-300))
        high, low = half + root, half - root
        self.ratio, self.stays, self.fades = low / high, (m - low * np.eye(2)) / (high - low), (high * np.eye(2) - m) / (high - low)

    def of(self, g: np.ndarray) -> np.ndarray:
        return self.stays + np.power(self.ratio, g)[:, None, None] * self.fades


class Texts:
    """Whole texts, by their active words: row and place of each, in order; and the words of each text that has some."""

    def __init__(self, row: np.ndarray, place: np.ndarray, length: np.ndarray):
        rows, begin, size = np.unique(row, return_index=True, return_counts=True)
        self.row, self.place, self.rows, self.length = row, place, rows, length[rows]
        self.begin, self.size = begin, size
        order = np.argsort(-size, kind="stable")  # texts with most active words first: those that go on are a prefix
        longest = int(size.max(initial=0))
        self.steps = [begin[order[: int(np.searchsorted(-size[order], -k, "left"))]] + k for k in range(longest)]
        self.gap = np.diff(place, prepend=0) - 1
        self.gap[begin] = place[begin]
        self.tail = self.length - place[begin + size - 1] - 1 if len(begin) else np.zeros(0, np.int64)

    def marginals(self, score: np.ndarray, other: float, trans: np.ndarray):
        """P(tag 1) of each active word, and (row, place, P) of every other word of these texts; score: of active words, other: of others."""
        n, psi = len(self.row), np.exp(trans)
        if not n:
            return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        emit = np.exp(np.stack([np.minimum(0, -score), np.minimum(0, score)], axis=1))
        calm = np.exp([min(0, -other), min(0, other)])
        powers = Powers(psi * calm)  # one word that is not active, after any word
        of = lambda v, g: np.einsum("ni,nij->nj", v, powers.of(g))
        back = lambda v, g: np.einsum("nij,nj->ni", powers.of(g), v)
        unit = lambda v: v / v.sum(axis=1, keepdims=True)
        # What comes into a gap from the left; for the gap before the first active word, one word has been taken.
        left, alpha, beta = np.empty((n, 2)), np.empty((n, 2)), np.empty((n, 2))
        for k, s in enumerate(self.steps):
            if k:
                left[s] = alpha[s - 1]
                came = of(left[s], self.gap[s]) @ psi
            else:
                left[s] = calm
                came = np.where((self.gap[s] > 0)[:, None], of(left[s], np.maximum(self.gap[s] - 1, 0)) @ psi, 1.0)
            alpha[s] = unit(came * emit[s])
        end = np.zeros(n, bool)
        end[self.begin + self.size - 1] = True
        tail = np.zeros(n, np.int64)
        tail[self.begin + self.size - 1] = self.tail
        right = np.ones((n, 2))  # what comes into the gap after a word from the right
        for s in reversed(self.steps):
            on = s[~end[s]]
            right[on] = unit((emit[on + 1] * beta[on + 1]) @ psi.T)
            g = tail[s]
            g[~end[s]] = self.gap[on + 1]
            beta[s] = unit(back(right[s], g))
        p = alpha * beta
        p = p[:, 1] / p.sum(axis=1)
        # Other words: before each active word, then after the last of each text.
        last = np.flatnonzero(end)
        sizes = np.concatenate([self.gap, self.tail])
        first = np.zeros(n, bool)
        first[self.begin] = True
        whole_right = unit((emit * beta) @ psi.T)
        lefts, rights = np.concatenate([left, alpha[last]]), np.concatenate([whole_right, np.ones((len(last), 2))])
        taken = np.concatenate([first, np.zeros(len(last), bool)]).astype(np.int64)
        start = np.concatenate([self.place - self.gap, self.place[last] + 1])
        of_row = np.concatenate([self.row, self.row[last]])
        gap = np.repeat(np.arange(len(sizes)), sizes)
        k = np.arange(len(gap)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = np.empty(len(gap))
        for a in range(0, len(gap), 1 << 18):
            g, j = gap[a : a + (1 << 18)], k[a : a + (1 << 18)]
            both = of(lefts[g], j + 1 - taken[g]) * back(rights[g], sizes[g] - 1 - j)
            out[a : a + (1 << 18)] = both[:, 1] / both.sum(axis=1)
        return p, of_row[gap], start[gap] + k, out


def _distinct(texts: list[str], labels: list[int]) -> tuple[list[str], list[int]]:
    """Without texts that share half of their least shingle hashes with one before: copies would pass chance words off as evidence."""
    of: dict[int, list[int]] = {}
    out_t, out_y = [], []
    for t, y in zip(texts, labels, strict=True):
        w = t.split()
        least = sorted({xxhash.xxh3_64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))})[:16]
        met = Counter(j for h in least for j in of.get(h, ()))
        if met and 2 * max(met.values()) >= len(least):
            continue
        for h in least:
            of.setdefault(h, []).append(len(out_t))
        out_t.append(t)
        out_y.append(y)
    return out_t, out_y


class Model:
    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, fit: tuple[float, float]):
        self.weights, self.bias, self.trans, self.fit = weights, bias, trans, fit
        # A word can only be active if its first or last characters, or all of it, begin, end or are a feature.
        k = AFFIXES.start
        self.first, self.last, self.whole = (pa.array(sorted({cut(f) for f in weights if f[mark] == sign}), pa.string()) for mark, sign, cut in ((0, "^", lambda f: f[1 : k + 1]), (-1, "$", lambda f: f[-k - 1 : -1]), (0, "=", lambda f: f[1:])))

    def emissions(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The score of each word, and whether it is active."""
        k = AFFIXES.start
        own, active = np.zeros(max(1, len(words))), np.zeros(max(1, len(words)), bool)
        maybe = pc.or_(pc.or_(pc.is_in(pc.utf8_slice_codeunits(words, 0, k), self.first), pc.is_in(pc.utf8_slice_codeunits(words, -k), self.last)), pc.is_in(words, self.whole))
        at = np.flatnonzero(maybe.to_numpy(zero_copy_only=False))
        get = self.weights.get
        for i, w in zip(at.tolist(), words.take(pa.array(at)).to_pylist(), strict=True):
            if found := [x for f in features(w) if (x := get(f)) is not None]:
                own[i], active[i] = sum(found), True
        return own, active

    def tag(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, word's place in it, probability) of each word of documents with active ones, and the documents' evidence."""
        ids, words, counts = words_of(column)
        own, active = self.emissions(words)
        at = np.flatnonzero(active[ids]) if len(ids) else np.zeros(0, np.int64)
        begin = starts_of(counts)
        doc = np.searchsorted(begin, at, "right") - 1
        place = at - begin[doc]
        p, doc2, place2, p2 = Texts(doc, place, counts).marginals(self.bias + own[ids[at]], self.bias, self.trans)
        evidence = np.zeros(len(counts))
        np.add.at(evidence, doc, -np.log1p(-np.minimum(p, 1 - 1e-12)))
        return np.concatenate([doc, doc2]), np.concatenate([place, place2]), np.concatenate([p, p2]), evidence

    def score(self, evidence: np.ndarray) -> np.ndarray:
        a, b = self.fit
        return 1 / (1 + np.exp(-(a + b * np.log(evidence + 1e-6))))


def train(texts: list[str], labels: list[int], rounds: int = 120) -> Model:
    """Fit the field, then the documents' logistic, on whole labelled texts."""
    all_texts, all_labels = texts, labels
    texts, labels = _distinct(texts, labels)
    y = np.array(labels, np.int64)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    ids, words, counts = words_of(pa.array(texts, pa.string()))
    at = starts_of(counts)
    index: dict[str, int] = {}
    feats = [np.array([index.setdefault(f, len(index)) for f in features(w)]) for w in words.to_pylist()]
    n1, n = np.zeros(len(index)), np.zeros(len(index))
    for k in range(len(texts)):
        own = np.unique(ids[at[k] : at[k + 1]])
        if len(own):
            some = np.unique(np.concatenate([feats[w] for w in own.tolist()]))
            n[some] += 1
            n1[some] += y[k]
    with np.errstate(divide="ignore", invalid="ignore"):
        q = n1 / n
        gain = n * (np.where(q > 0, q * np.log(q / rate), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - rate)), 0))
    seed = (q >= 0.9) & (n1 >= 3) & (gain >= math.log(max(2, (n >= 3).sum()) / 0.05))
    seeded = np.array([bool(seed[f].any()) for f in feats] or [False])
    row = np.repeat(np.arange(len(texts)), counts)
    positive = seeded[ids] & (y[row] == 1) if len(ids) else np.zeros(0, bool)
    used = np.unique(np.concatenate([feats[w] for w in np.unique(ids[positive]).tolist()] or [np.zeros(0, np.int64)]))
    used = used[q[used] >= max(0.5, 1.5 * rate)]  # the others, such as short affixes of common words, tell nothing
    place = np.full(len(index), -1)
    place[used] = np.arange(len(used))
    kept = [place[f][place[f] >= 0] for f in feats]
    chain = Chain(np.array([len(k) > 0 for k in kept] or [False])[ids], row)
    w_of, tags = ids[chain.at], positive[chain.at].astype(float)
    pair_word = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
    pair_feat = np.concatenate(kept or [np.zeros(0, np.int64)])
    # Adam on the log-likelihood with a Gaussian prior.
    theta = np.zeros(len(used) + 4)
    theta[-4] = -2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    joined = chain.step[1:] > 0 if len(chain.at) else np.zeros(0, bool)
    seen = np.zeros((2, 2))
    if joined.any():
        np.add.at(seen, (tags[:-1][joined].astype(int), tags[1:][joined].astype(int)), 1)
    for t in range(1, rounds + 1 if len(used) else 1):
        word_score = np.bincount(pair_word, theta[:-4][pair_feat], len(kept))
        trans = np.array([[0, theta[-3]], [theta[-2], theta[-1]]])
        p, pairs = chain.marginals(theta[-4] + word_score[w_of], trans)
        by_word = np.bincount(w_of, tags - p, len(kept))
        more = seen - pairs
        slope = np.concatenate([np.bincount(pair_feat, by_word[pair_word], len(used)), [(tags - p).sum(), more[0, 1], more[1, 0], more[1, 1]]]) - 0.5 * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    names = {j: f for f, j in index.items()}
    model = Model({names[j]: float(theta[k]) for k, j in enumerate(used.tolist())}, float(theta[-4]), np.array([[0, theta[-3]], [theta[-2], theta[-1]]]), (0.0, 1.0))
    evidence = np.concatenate([model.tag(pa.array(all_texts[a : a + 500], pa.string()))[3] for a in range(0, len(all_texts), 500)] or [np.zeros(0)])
    model.fit = _logistic(np.log(evidence + 1e-6), np.array(all_labels, float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method; a slope under zero would turn the evidence round and is held at zero."""
    centre, spread = (x.mean(), x.std() + 1e-9) if len(x) else (0.0, 1.0)
    z = (x - centre) / spread
    a = b = 0.0
    for _ in range(100):  # halved steps, so that separable classes do not throw it off
        p = 1 / (1 + np.exp(-np.clip(a + b * z, -30, 30)))
        w = p * (1 - p)
        ga, gb = (y - p).sum() - 1e-2 * a, ((y - p) * z).sum() - 1e-2 * b
        haa, hab, hbb = w.sum() + 1e-2, (w * z).sum(), (w * z * z).sum() + 1e-2
        det = haa * hbb - hab * hab
        a, b = a + np.clip((hbb * ga - hab * gb) / det, -2, 2) / 2, b + np.clip((haa * gb - hab * ga) / det, -2, 2) / 2
    a, b = a - b * centre / spread, b / spread
    return (float(a), float(b)) if b > 0 else (float(np.log((y.mean() if len(y) else 0.0) + 1e-6)), 0.0)


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on labelled documents whose crc32 of doc_id mod 3 is not 1: of each class up to about `sample`, by a hash of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.filter(crc_mod("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    chosen = [known.filter((F.col("toxic") == y) & (spread <= int(1_000_003 * min(1.0, sample / n)))) for y, n in sorted(sizes.items())]
    if not chosen:
        return train([], [])
    small = chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(small), "doc_id").select("doc_id", "text", "toxic")
    made = rows.repartition(1).mapInArrow(_trainer, "model binary").first()
    return Model(*pickle.loads(made.model)) if made else train([], [])


def _trainer(batches):
    """Fits in a task: the sample, and what training takes, never come to the driver."""
    rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    x = train([r[1] for r in rows], [r[2] for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((x.weights, x.bias, x.trans, x.fit))], pa.binary())], ["model"])


def _scorer(model: Model):
    def run(batches):
        for b in slices(batches, limit=1 << 20):
            doc, place, p, evidence = model.tag(b.column(1))
            hit = p >= 0.5
            spans: dict[int, list[int]] = {}
            for d, k in zip(doc[hit].tolist(), place[hit].tolist(), strict=True):
                spans.setdefault(d, []).append(k)
            begin: list[list[int]] = [[] for _ in range(b.num_rows)]
            end: list[list[int]] = [[] for _ in range(b.num_rows)]
            for d, places in spans.items():
                wanted = set(places)
                for k, m in enumerate(WORD.finditer(b.column(1)[d].as_py())):
                    if k in wanted:
                        begin[d].append(m.start())
                        end[d].append(m.end())
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(evidence)), pa.array(begin, kind), pa.array(end, kind)], ["doc_id", "score", "span_from", "span_to"])

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, span_from, span_to): 0 to 1, and the offending words' places in code points, end exclusive.

    A null or empty text has no evidence and gets the lowest score. Repeated rows keep a row each; extra columns are
    ignored; without labels every score is alike. An empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(model), SCORES)


def clean(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """docs without the rows whose score reaches `reject`. Rows with a null doc_id stay."""
    bad = scores(docs, fitted(docs, labels)).filter(F.col("score") >= reject).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")
