import itertools
import math
import random

import numpy as np
import pyarrow as pa

from lorekeep.llm import langid
from lorekeep.llm.common import crc_mod

SCHEMA = "doc_id long, text string, lang string, score double"


def test_forward_sums_all_segmentations():
    pieces = [langid.MARK, langid.MARK + "a", "a", "b", "ab", "ba", langid.MARK + "ab", "bab"]
    rng = np.random.default_rng(3)
    p = np.vstack([rng.dirichlet(np.ones(len(pieces)), 2).T, np.zeros((1, 2))])
    words = ["a", "abab", "babab", "z", "abz"]
    got = langid.Model(["x", "y"], p, pieces).words(words)
    for w, row in zip(words, got):
        s = langid.MARK + w
        for k in range(2):
            total = 0.0
            for cut in itertools.product((0, 1), repeat=len(s) - 1):
                ends = [i + 1 for i, c in enumerate(cut) if c] + [len(s)]
                parts = [s[a:b] for a, b in zip([0, *ends], ends)]
                total += math.prod((p[pieces.index(x), k] if x in pieces else 0) + (langid.LETTER if len(x) == 1 else 0) for x in parts)
            assert math.isclose(row[k], math.log(total), rel_tol=1e-9)


def test_learning_raises_likelihood():
    pieces = langid.pieces_of()
    words = {"the": 50, "other": 9, "then": 7, "thing": 4}
    _, one = langid.learn({"en": words}, pieces, 1)
    _, many = langid.learn({"en": words}, pieces, 6)
    n = np.array(list(words.values()))
    at = [langid.Model(["en"], p, pieces).words(list(words))[:, 0] @ n for p in (one, many)]
    assert at[1] >= at[0]


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(6)
    stems = {"en": ["the", "and", "thing", "would", "with", "ness"], "de": ["und", "nicht", "schön", "werden", "keit", "ß"], "fr": ["les", "était", "vous", "que", "aux", "ç"]}
    rows = [(i, " ".join("".join(rng.sample(stems[g], 2)) for _ in range(12)), g, 0.0) for i in range(240) for g in [("en", "de", "fr")[i % 3]]]
    rows += [(900, None, "en", 0.0), (901, "", "de", 0.0), (902, "12 ... 3!", None, 0.0), (903, "THE and " * 30000 + "w" * 5000, None, 0.0), (3, "the same and the thing", "en", 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = langid.predict(df, langid.fitted(df)).collect()
    assert len(out) == len(rows)
    held = {r.doc_id for r in df.filter(crc_mod("doc_id", 3) == 1).collect()}
    got = {r.doc_id: r for r in out if r.doc_id != 3}
    test = [(i, g) for i, _, g, _ in rows if i in held and i < 900 and i != 3]
    assert sum(got[i].lang_pred == g for i, g in test) >= 0.97 * len(test)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == "en" and all(0 <= r.score <= 1 for r in out)


def test_nothing_to_learn_and_empty(spark):
    assert langid.Model(*langid.learn({}, ["a"]), ["a"]).predict(pa.array(["abc", None]))[0] == ["und", "und"]
    df = spark.createDataFrame([], SCHEMA)
    assert langid.predict(df, langid.fitted(df)).count() == 0
