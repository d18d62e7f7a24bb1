import random
import re

import pytest

from lorekeep.llm import decontaminate as d

SCHEMA = "doc_id long, text string, item_ids string, n_words int"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None:
            for k in range(max(1, len(w) - 9) if w else 0):
                windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for doc, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for x, ids in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found |= ids
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def cases():
    rng = random.Random(3)
    vocab = ["a", "b", "c", "é", "7", "dd"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 5, 9, 10, 11, 14, 25]))) for i in range(24)] + [(30, None), (31, ""), (32, "..."), (None, say(12)), (33, "a a a a a a a a a a a a a")]
    docs = [(i, say(rng.randrange(60)), "x", 1) for i in range(40)]
    docs += [(100 + k, f"{say(5)}. {t}! {say(4)}".upper(), "", 0) for k, (_, t) in enumerate(items[:20])]
    docs += [(200, None, "", 0), (201, "", "", 0), (202, "a " * 20000, "", 0), (203, items[3][1], "", 0), (203, items[3][1], "", 0)]
    return docs, items


@pytest.mark.parametrize("block", [10**6, 60])
def test_matches_brute_force(spark, block):
    docs, items = cases()
    found = d.matches(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), block_chars=block).withColumn("n", d.n_hit())
    got = sorted(((r.doc_id, r.n_words, r.n, tuple(r.item_ids)) for r in found.collect()), key=str)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs, items = cases()
    no_docs, no_items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert d.matches(no_docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    got = d.matches(spark.createDataFrame(docs, SCHEMA), no_items).collect()
    assert len(got) == len(docs) and not any(r.hit_from for r in got)
    assert d.clean(spark.createDataFrame(docs, SCHEMA), no_items).count() == len(docs)
