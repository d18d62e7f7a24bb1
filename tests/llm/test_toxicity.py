import itertools
import random

import numpy as np
import pyarrow as pa

from lorekeep.llm import toxicity as t
from lorekeep.llm.common import crc_mod

SCHEMA = "doc_id long, text string, score double, toxic int"


def corpus(n, rng):
    plain = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(3, 60))]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["nasty", "rotten", "Zorg" + rng.choice(plain)])
        rows.append((i, " ".join(words) + ".", 0.5, int(bad)))
    return rows


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    active = np.array([1, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0], bool)
    row = np.array([0] * 13 + [1] * 2)
    chain = t.Chain(active, row)
    score, trans = rng.normal(0, 2, len(chain.at)), np.array([[0, -0.7], [0.4, 1.1]])
    p, pairs = chain.marginals(score, trans)
    begin = [*np.flatnonzero(chain.step == 0).tolist(), len(score)]
    total = np.zeros((2, 2))
    for a, b in itertools.pairwise(begin):
        z, mass, joint = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(s for s, k in zip(score[a:b], y) if k) + sum(trans[i, j] for i, j in itertools.pairwise(y)))
            z += w
            mass += w * np.array(y)
            for i, j in itertools.pairwise(y):
                joint[i, j] += w
        assert np.allclose(p[a:b], mass / z)
        total += joint / z
    assert np.allclose(pairs, total)


def uncut(score, trans):
    """Forward-backward word by word."""
    psi, n = np.exp(trans), len(score)
    emit = np.exp(np.stack([np.minimum(0, -score), np.minimum(0, score)], axis=1))
    alpha, beta = [emit[0]], [np.ones(2)]
    for k in range(1, n):
        a = (alpha[-1] @ psi) * emit[k]
        alpha.append(a / a.sum())
        b = psi @ (emit[n - k] * beta[-1])
        beta.append(b / b.sum())
    both = np.array(alpha) * np.array(beta[::-1])
    return both[:, 1] / both.sum(axis=1)


def test_whole_texts_equal_an_uncut_chain():
    rng = np.random.default_rng(5)
    texts = ["", "cc cc", *(" ".join(rng.choice(["bad", "ugly", "cc", "dd"], p=[0.05, 0.03, 0.5, 0.42], size=n)) for n in (1, 2, 7, 40, 300, 5000)), "bad", "ugly bad", "cc bad cc"]
    for trans in ([[0, -1.5], [-0.4, 1.2]], [[0, 0.0], [0, 0]], [[0, 1.0], [2.0, -0.5]]):
        own = {"bad": 3.0, "ugly": -1.0}
        model = t.Model({"=" + w: x for w, x in own.items()}, -2.5, np.array(trans), (0.0, 1.0))
        doc, place, p, evidence = model.tag(pa.array(texts))
        got = {(d, k): x for d, k, x in zip(doc.tolist(), place.tolist(), p.tolist(), strict=True)}
        for i, text in enumerate(texts):
            words = text.split()
            if not any(w in own for w in words):
                assert not evidence[i] and not any(d == i for d, _ in got)
                continue
            want = uncut(np.array([-2.5 + own.get(w, 0.0) for w in words]), np.array(trans))
            assert np.allclose([got[i, k] for k in range(len(words))], want, atol=1e-9)
            assert np.isclose(evidence[i], sum(-np.log1p(-x) for w, x in zip(words, want, strict=True) if w in own))


def test_held_out_accuracy_and_offsets(spark):
    rows = corpus(900, random.Random(4)) + [(5000, None, 0.0, None), (5001, "", 0.0, None), (5002, "ab " * 40000 + "NASTY", 0.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = df.select("doc_id", "toxic").filter("doc_id < 5000").withColumn("doc_id", df.doc_id)
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    out = {r.doc_id: r for r in t.scores(df, t.fitted(df, labels)).collect()}
    held = {r.doc_id for r in df.filter(crc_mod("doc_id", 3) == 1).collect()}
    wrong = [i for i, _, _, y in rows if y is not None and i in held and (out[i].score >= t.REJECT) != bool(y)]
    assert len(wrong) <= 0.03 * len(held)
    assert out[5000].score == out[5001].score < 0.5 and out[5002].score > 0.5
    assert (out[5002].span_from, out[5002].span_to) == ([120000], [120005])
    assert t.clean(df, labels).filter("doc_id = 5000").count() == 1


def test_training_is_a_task(spark, monkeypatch):
    """The driver gets the fitted model alone; sample and training stay in a task."""
    df = spark.createDataFrame(corpus(300, random.Random(6)), SCHEMA)
    chosen = sorted((r.doc_id, r.text, r.toxic) for r in df.filter(crc_mod("doc_id", 3) != 1).collect())
    want = t.train([c[1] for c in chosen], [c[2] for c in chosen])
    asked, train = [], t.train
    monkeypatch.setattr(t, "train", lambda *a: asked.append(1) or train(*a))  # a task has a copy of `asked`
    got = t.fitted(df, df.select("doc_id", "toxic"))
    assert got.weights == want.weights and got.bias == want.bias and got.fit == want.fit and (got.trans == want.trans).all() and not asked


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    df = spark.createDataFrame([(1, "some words", 0.0, 1)], SCHEMA)
    assert [r.score < t.REJECT for r in t.scores(df, t.fitted(df, none)).collect()] == [True]
    assert t.scores(spark.createDataFrame([], SCHEMA), t.train([], [])).count() == 0
    assert t.train(["x"], [1]).tag(pa.array(["", None]))[3].tolist() == [0, 0]
