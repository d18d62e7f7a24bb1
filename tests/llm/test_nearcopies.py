import random

import pytest

import corpus_pipeline
from lorekeep.llm import nearcopies, setjoin, simhash

SCHEMA = "doc_id long, text string, lang string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets, root = {i: shingles(t) for i, t, _ in rows}, {i: i for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in root if find(i) == i}


@pytest.mark.parametrize(("paired", "sizes"), [(32, {}), (3, {"ALL_PAIRS": 8, "LEADERS": 2, "FEW": 1, "AT_ONCE": 500, "HELD": 20})])
def test_stage_finds_every_near_copy(spark, monkeypatch, paired, sizes):
    """Copies with single words changed, most of them further apart than two bits of a fingerprint."""
    for name, value in {"PAIRED": paired, **sizes}.items():
        monkeypatch.setattr(setjoin, name, value)
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(900)]
    rows = [(900, None, "x"), (901, " \n", "x"), (902, "Two words", "x"), (903, "two  words", "x"), (904, "a b c d", "x")]
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([12, 60, 100, 200]) if g else 200)]
        for k in range(2 if g else 40):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((g * 1000 + 1000 + k, " ".join(w), "x"))
    want = brute(rows)
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want) < len(rows) - 30  # most of the copies are found


def test_fingerprints_group_first(spark, monkeypatch):
    """Pairs that SimHash links are verified first; the join's pairs are verified only if they are in no group by then."""
    rng = random.Random(2)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    base, far = say(400), say(120)
    near = [*base[:399], "x"]
    apart = [w if k % 40 else f"y{k}" for k, w in enumerate(far)]  # too many bits away
    rows = [(i, " ".join(w), "x") for i, w in enumerate([base, near, [*near, "z"], far, apart, say(50)])]
    bits = [int(x) for x in simhash.fingerprint([t.encode() for _, t, _ in rows])]
    assert (bits[0] ^ bits[1]).bit_count() <= 2 < (bits[3] ^ bits[4]).bit_count()
    asked, verified = [], nearcopies._verified
    monkeypatch.setattr(nearcopies, "_verified", lambda docs, pairs, *a: asked.append(pairs.count()) or verified(docs, pairs, *a))
    got = {r.doc_id: r.component_id for r in nearcopies.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5} and {i for i, c in got.items() if i == c} == brute(rows)
    assert len(asked) == 2 and asked[0] >= 1 and asked[1] >= 1
