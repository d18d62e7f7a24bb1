import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lorekeep.llm import linededup as l
from lorekeep.llm import setjoin

SCHEMA = "doc_id long, text string, print string, number int"


def brute(rows, t=0.8):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    lines = sorted({(i, k, frozenset(re.findall(r"[^\x20\x09-\x0D]+", low(x)))) for i, text, *_ in rows if i is not None for k, x in enumerate((text or "").split("\n"))}, key=lambda x: x[:2])
    gone = set()
    for n, (i, k, s) in enumerate(lines):
        if s and any(p and (i, k) != (j, m) and 10 * len(p & s) >= 8 * len(p | s) for j, m, p in lines[:n]):
            gone.add((i, k))
    return gone


def cases(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    lines = [" ".join(rng.choices(vocab, k=rng.choice([1, 2, 4, 5, 9, 12, 20]))) for _ in range(90)]
    base = " ".join(f"hot{k}" for k in range(20))
    rows = []
    for i in range(70):
        own = []
        for _ in range(rng.randrange(1, 8)):
            w = rng.choice(lines).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(vocab).upper()
            own.append(" ".join(w))
        w = base.split()
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(20)] = f"x{rng.randrange(99)}"
        rows.append((i, "\n".join([*own, " ".join(w), ""]), "clash", 1))
    return rows + [(100, None, "", 0), (101, "", "", 0), (102, " \n\t\n", "", 0), (103, "big " * 3000 + "\n" + "Big", "", 0), (None, "w1 w2", "", 0), (5, rows[5][1], "", 0)]


SMALL = {"FEW": 1, "ALL_PAIRS": 6, "LEADERS": 2, "AT_ONCE": 300, "HELD": 40, "COMPARED": 50, "HOT": 5}


@pytest.mark.parametrize(("paired", "sizes"), [(4, {}), (32, {}), (3, SMALL), (2, SMALL | {"HOT": 1 << 16, "HELD": 500})])
def test_matches_brute_force(spark, monkeypatch, paired, sizes):
    """Also with groups that are compared in parts, told in parts, or dealt by size."""
    for name, value in {"PAIRED": paired, **sizes}.items():
        monkeypatch.setattr(setjoin, name, value)
    rows = cases(paired)
    got = l.find(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows if r[0] is not None)
    assert {(r.doc_id, k) for r in got for k in r.removed} == brute(rows)
    assert {r.doc_id: r.n_lines for r in got}[102] == 3


def test_clean_edits_text_only(spark):
    rows = [(1, "a b c d e\nother line", "", 0), (2, "A b c d e\nnew words here", "", 0), (3, None, "", 0), (None, "a b c d e", "", 0)]
    got = sorted(map(tuple, l.clean(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([rows[0], (2, "new words here", "", 0), rows[2], rows[3]], key=str)
    assert l.clean(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("held", [1 << 19, 64])
def test_rows_travel_in_packs(monkeypatch, held):
    """The shuffle sees a row a bucket, not one a prefix word; a bucket too large to hold still tells or marks every pair."""
    monkeypatch.setattr(setjoin, "HELD", held)
    rng = random.Random(1)
    texts = [" ".join(["common", *rng.sample([f"w{k}" for k in range(9)], 4)]) for _ in range(400)] + [f"own{k}" for k in range(99)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    order = setjoin.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rows = sum(x.shape[1] for x in l._prefixes(order, 0.6)([batch]))
    packs = pa.Table.from_batches(setjoin.packed(l._prefixes(order, 0.6), 4)([batch])).sort_by("bucket")
    assert packs.num_rows == 4 < rows == sum(len(p) for p in packs["pack"].to_pylist()) // (8 * setjoin.COLUMNS)
    met = pa.Table.from_batches(setjoin.meet(0.6)(packs.combine_chunks().to_batches())).to_pylist()
    told, crowds = {(m["a_doc"], m["b_doc"]) for m in met if m["key"] is None}, {}
    for m in met:
        if m["key"] is not None:
            crowds.setdefault(m["key"], {})[m["b_doc"]] = m["crowded"]
    sets = {i: frozenset(x.split()) for i, x in reversed(list(enumerate(texts)))}
    first = {i: s for i, s in sets.items() if min(k for k, x in sets.items() if x == s) == i}
    near = [(i, j) for i in first for j in first if i < j and len(first[i] & first[j]) >= 0.6 * len(first[i] | first[j])]
    assert near and all(p in told or any(p[0] in c and c.get(p[1]) for c in crowds.values()) for p in near)
    assert all(max(c.values()) for c in crowds.values()) and (held > 64 or crowds)
