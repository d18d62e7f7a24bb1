import hashlib
import random
import re
from collections import Counter

import numpy as np

from lorekeep.llm import substring as s

SCHEMA = "doc_id long, text string, key string, n_words int"


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (doc, *_), w in zip(rows, words):
        hit = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in hit)
        out.append((doc, len(w), len(hit), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_cover_has_every_difference():
    assert {(a - b) % s.PERIOD for a in s.COVER for b in s.COVER} == set(range(s.PERIOD))


def test_matches_brute_force(spark):
    rng = random.Random(9)
    vocab = ["a", "B", "b", "é", "x\x1cy", "zz", " "]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    parts = [say(n) for n in (34, 35, 36, 50, 90, 140, 300)]
    rows = []
    for i in range(120):
        pick = [say(rng.randrange(0, 60)), rng.choice(parts), say(rng.randrange(0, 25))]
        if rng.random() < 0.3:
            w = rng.choice(parts).split(" ")
            a = rng.randrange(len(w))
            pick.append(" \n".join(w[a : a + rng.randrange(20, 80)]))
        rows.append((i, "  ".join(pick), "clash", 1))
    rows += [(200, None, "", 0), (201, "", "", 0), (202, "a " * 5000, "", 0), (203, rows[3][1], "", 0), (203, rows[3][1], "", 0), (204, rows[5][1] + " more", "", 0), (None, rows[6][1], "", 0), (7, "other text of seven", "", 0), (205, parts[6], "", 0), (206, parts[6].upper(), "", 0)]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in s.remove(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty(spark):
    assert s.remove(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_within_a_slice_are_not_gathered():
    h, g = np.array([7, 5, 7, 7, 9, 5, 7], np.uint64), np.array([1, 2, 1, 1, 3, 4, 1], np.uint64)
    out, sure = s._spread(np.arange(7), h, g)
    assert sure.tolist() == [True, False, True, True, False, False, True]
    assert Counter(out.tolist())[7] == 1 and len(set(out[sure].tolist())) == 4
    assert (out[~sure] == h[~sure].view(np.int64)).all()
    assert not len(s._spread(np.arange(0), h[:0])[0])


def test_a_passage_of_very_many_rows(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"{passage} own{i} words{i}" if i % 3 else f"own{i} {passage}", "", 0) for i in range(900)]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in s.remove(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()]
    assert sorted(got, key=str) == brute(rows)
