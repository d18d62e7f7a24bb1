import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lorekeep.llm import lm

SCHEMA = "doc_id long, text string, key long, n_tokens string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def cases():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(160):
        w = ["The"]
        for _ in range(rng.randrange(1, 120)):
            w.append(rng.choice(["of", "and", "x" + w[-1][:3]]) if rng.random() < 0.5 else rng.choice(vocab[: 1 + int(400 * rng.random() ** 3)]))
        rows.append((i, " ".join(w), 1, "clash"))
    return rows + [(500, None, 0, ""), (501, "", 0, ""), (502, "big Word " * 20000, 0, ""), (3, rows[3][1], 0, "")]


@pytest.mark.parametrize("local", [1 << 18, 40])
def test_base_is_exact_and_the_model_beats_it(spark, monkeypatch, local):
    monkeypatch.setattr(lm, "LOCAL", local)
    rows = cases()
    count = Counter(w for i, t, *_ in rows if not held(i) for w in words(t))
    total, kinds = sum(count.values()), len(count)
    got = lm.scores(spark.createDataFrame(rows, SCHEMA))
    out = sorted(got.collect(), key=lambda r: r.doc_id)
    assert len(out) == len(rows)
    for (i, t, *_), r in zip(sorted(rows, key=lambda r: r[0]), out):
        w = words(t)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held(i), len(w), sum(count[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0
    assert all(r.perplexity < r.base_perplexity for r in lm.perplexity(got).collect())


def law(n, a, d):
    """P(t) of the tables of a dish with n customers, whose seatings weigh a for each table and n - d t for its later customers."""
    p = np.zeros(n + 2)
    p[1] = 1
    for k in range(1, n):
        t = np.arange(n + 2)
        p = p * np.maximum(k - d * t, 0) + np.concatenate([[0], p[:-1] * a])
        p /= p.sum()
    return p


@pytest.mark.parametrize(("n", "a", "d"), [(2, 0.3, 0.5), (5, 0.8, 0.5), (16, 0.05, 0.8), (17, 2.0, 0.3), (60, 3.0, 0.7), (500, 0.6, 0.4)])
def test_tables_follow_their_law(n, a, d):
    m = 20000
    key = np.arange(m) * 7919 + 1
    draw = lambda: lm.Tables(d).draw(np.full(m, n), np.full(m, a), key, 3)
    t = draw()
    assert np.abs(np.bincount(t.astype(int), minlength=n + 2) / m - law(n, a, d)).max() < 0.015
    assert (draw() == t).all()  # a task that runs again draws the same


@pytest.mark.parametrize(("n", "a", "d"), [(700, 0.6, 0.4), (3000, 2.0, 0.7), (3000, 40.0, 0.75), (5000, 0.01, 0.3)])
def test_many_customers_have_about_the_tables_of_their_law(n, a, d):
    t = lm.Tables(d).draw(np.full(4000, n), np.full(4000, a), np.arange(4000) * 7919 + 1, 1)
    mean = (law(n, a, d) * np.arange(n + 2)).sum()
    assert abs(t.mean() - mean) < 0.03 * mean + 0.03


def test_log_gamma():
    for x in (1e-9, 0.3, 1.0, 7.5, 1e3, 1e9):
        assert math.isclose(lm._log_gamma(np.array([x]))[0], math.lgamma(x), rel_tol=1e-9, abs_tol=1e-9)


def test_scores_of_texts_without_repeated_pairs_are_exact(spark):
    """Where no pair and no word comes twice, every dish has one table, and the model has a closed form."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(6)), 0, "") for i in range(60)]
    train = [r for r in rows if not held(r[0])]
    count = Counter(w for _, t, *_ in train for w in words(t))
    ends, n, kinds = count[None], sum(count.values()), len(count)
    d = lm.discount_of(n, 0)
    # Customers of the root: one a pair; the end has one from each last word.
    d0, b = lm.discount_of(kinds - 1, 0), 1 / (kinds + 1)
    got = {r.doc_id: r for r in lm.scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    new, start_new = (1 + d) / 2, (1 + d * len(train)) / (1 + len(train))
    for i, t, *_ in train:
        # A root word of one customer has one table; only the end's tables are drawn, between 1 and its customers.
        low, high = [], []
        for out, tables in ((low, ends), (high, 1)):
            spare = lambda k: (1 + d0 * (kinds - 1 + k)) * b / (1 + n)
            for j, w in enumerate(words(t)):
                root = ((ends - d0 * tables) if w is None else 1 - d0) / (1 + n) + spare(1 if out is low else ends)
                context = (1 - d) / (1 + len(train)) + start_new * root if j == 0 else (1 - d) / 2 + new * root
                out.append(math.log10(context))
        below, above = sorted((sum(low), sum(high)))
        assert below - 1e-9 <= got[i].score <= above + 1e-9 and above - below < 0.8


def test_empty_and_untrained(spark):
    assert lm.scores(spark.createDataFrame([], SCHEMA)).count() == 0
    only = next(i for i in range(50) if held(i))
    r = lm.scores(spark.createDataFrame([(only, "a b", 0, "")], SCHEMA)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


def test_every_context_and_word_has_its_own_statistics(spark):
    """Far more contexts than any fixed inventory: a word's own successor is likely after it, and not after another with the same ending."""
    rng, n = random.Random(3), 3000
    rows = [(i, " ".join(f"a{k}same b{k}next" for k in rng.sample(range(n), 40)), 0, "") for i in range(400) if not held(i)]
    seen = [int(w[1:-4]) for _, t, *_ in rows for w in t.split() if w[0] == "a"]
    k = [i for i, c in Counter(seen).items() if c > 2]
    assert len(k) > 2000
    asked = [i for i in range(1000, 3000) if held(i)][:2]
    right, wrong = (" ".join(f"a{i}same b{k[(j + by) % len(k)]}next" for j, i in enumerate(k)) for by in (0, 1))
    got = {r.doc_id: r for r in lm.scores(spark.createDataFrame([*rows, (asked[0], right, 0, ""), (asked[1], wrong, 0, "")], SCHEMA)).filter("held_out").collect()}
    assert got[asked[0]].base_score == pytest.approx(got[asked[1]].base_score)
    assert got[asked[0]].score - got[asked[1]].score > 2 * len(k)  # a hundred times as likely, for each pair


def test_contexts_and_root_are_distributions(spark):
    rng = np.random.default_rng(2)
    n, root = rng.poisson(1.5, (50, 40)), rng.dirichlet(np.ones(40))
    group = np.repeat(np.arange(50), 40)
    one = np.ones(50)
    _, tables, own, back = lm.seat_leaves(group, n.ravel(), np.tile(root, 50), one, 0 * one, n.sum(axis=1), lm.Tables(0.6), np.arange(2000), rng)
    p = (own + back * np.tile(root, 50)).reshape(50, 40)
    assert np.allclose(p.sum(axis=1), 1) and (p > 0).all()
    rows = [(w, 5, int(c)) for w, c in enumerate(rng.poisson(4, 200) + 1)]
    priced, never = lm.root_of(spark.createDataFrame(rows, "word long, times long, customers long"), len(rows))
    assert math.isclose(sum(r.root for r in priced.collect()) + never, 1, rel_tol=1e-9)


def test_shares_of_large_restaurants_change_little(spark, monkeypatch):
    rows = cases()
    whole = {(r.doc_id, r.n_tokens): r.score for r in lm.scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    for name, value in {"SHARE": 5000, "BUCKET": 3000, "SLICE": 900, "BLOCK": 20, "LOCAL": 30, "FREQUENT": 3}.items():
        monkeypatch.setattr(lm, name, value)
    parts = {(r.doc_id, r.n_tokens): r.score for r in lm.scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert parts.keys() == whole.keys()
    assert all(abs(parts[k] - whole[k]) < 0.05 * abs(whole[k]) + 0.003 * k[1] for k in whole)


def test_work_per_token_does_not_search_the_inventory(monkeypatch):
    """Words are looked up once in a slice, however many tokens they have, and small batches share a slice."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 500) % 300) for _ in range(40)]
    top = lm.Top(np.append(np.arange(1000) * 7919, lm.START), np.arange(1001, 0, -1), 10**6, 1000)
    none = lm.Pairs(np.array([], int), np.array([], int), np.array([]))
    batches = [pa.RecordBatch.from_pydict({"text": texts[i : i + 4], "train": [True] * len(texts[i : i + 4])}) for i in range(0, len(texts), 4)]
    looked, index = [], lm.Top.index
    monkeypatch.setattr(lm.Top, "index", lambda self, h: looked.append(len(h)) or index(self, h))
    out = list(lm._pairs(top, 1)(iter(batches)))
    assert sum(sum(b.column("times").flatten().to_pylist()) for b in out) == 40 * 501
    assert sum(looked) <= 302 and len(out) == 1
    looked.clear()
    named = [pa.RecordBatch.from_pydict({"id": np.arange(b.num_rows), "text": b.column(0), "salt": np.zeros(b.num_rows, np.int32), "held_out": b.column(1), "doc_id": np.arange(b.num_rows)}) for b in batches]
    near = list(lm._near(top, none)(iter(named)))
    assert sum(looked) <= 302 and sum(sum(b.column("n_tokens").to_pylist()) for b in near) == 40 * 501


def test_places_sort_with_their_values():
    rng = np.random.default_rng(1)
    for high in (1, 5, 1 << 20, 1 << 62):
        for n in (0, 1, 2, 1000, 4096):
            key = rng.integers(0, high, n)
            assert (lm._order(key) == np.argsort(key, kind="stable")).all()
