import hashlib
import random
from fractions import Fraction

import pytest

from lorekeep.llm import mixing

SCHEMA = "doc_id long, source string, text string, slot string"


@pytest.mark.parametrize("share", [[1], [1, 1], [1, 2, 4], [7, 1, 1, 1], [500, 10, 3, 1, 486], [3] * 11])
def test_every_source_stays_within_one_block(share):
    slots = mixing.period_slots(share)
    period = sum(share)
    assert sorted(s for x in slots for s in x) == list(range(period))
    for p, x in zip(share, slots):
        got = 0
        for t in range(period + 1):
            got += t - 1 in x
            assert abs(got - Fraction(t * p, period)) < 1


def brute(rows, share, block):
    """Slot by slot: earliest deadline among released blocks, phase after phase."""
    left = [-(-n // block) for n in rows]
    done, out = [0] * len(rows), []
    while any(left):
        act = [i for i in range(len(rows)) if left[i]]
        period = sum(share[i] for i in act)
        used, t = {i: 0 for i in act}, 0
        while all(left[i] for i in act):
            ready = [i for i in act if used[i] * period // share[i] <= t]
            i = min(ready, key=lambda i: (-(-(used[i] + 1) * period // share[i]), i))
            out.append((i, done[i]))
            used[i] += 1
            done[i] += 1
            left[i] -= 1
            t += 1
    return out


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 50)
    rng = random.Random(8)
    names = ["a"] * 300 + ["b"] * 90 + [None] * 41 + ["c"] * 5 + [""]
    rows = [(i * 7 - 50, s, "t", "clash") for i, s in enumerate(names)] + [(13, "a", "again", "x"), (None, "b", None, None)]
    rng.shuffle(rows)
    for weights in (None, {"a": 0.1, "b": 0.6, "c": 0.3, "zz": 5, None: 0}):
        got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights, period=40, block=8).collect()
        keys = sorted({r[1] for r in rows}, key=lambda s: (s is None, s))
        count = [sum(r[1] == k for r in rows) for k in keys]
        if weights is None:
            want = [n**0.5 for n in count]
        else:
            given = [weights.get(k) or 0 for k in keys]
            want = [w or 0.1 / len(keys) for w in given]
        order = brute(count, mixing.shares(want, 40), 8)
        ranked = {k: sorted((r for r in rows if r[1] == k), key=lambda r: (hashlib.md5((str(r[0]) if r[0] is not None else "").encode()).hexdigest(), r[0] or 0)) for k in keys}
        flat = [(keys[i], r[0], b, slot) for slot, (i, b) in enumerate(order) for r in ranked[keys[i]][b * 8 : b * 8 + 8]]
        assert sorted(((r.position, r.source, r.doc_id, r.block, r.slot) for r in got), key=str) == sorted(((p, s, d, b, t) for p, (s, d, b, t) in enumerate(flat)), key=str)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "source", "text", "block", "slot", "position"]


def test_rows_that_repeat_a_doc_id_have_one_order(spark):
    rows = [(5, "a", t, "k") for t in ("one", "two", None, "three", "two")] + [(i, "b", "x", "k") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    made = [sorted((r.position, r.source, r.doc_id, str(r.text)) for r in mixing.mix(docs.repartition(n), block=2).collect()) for n in (1, 3, 8)]
    assert made[0] == made[1] == made[2]
    assert [t for _, _, d, t in made[0] if d == 5 and t != "x"] == ["None", "one", "three", "two", "two"]
