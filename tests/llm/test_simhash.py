import re

import numpy as np
import pytest
import xxhash

from lorekeep.llm import simhash

SCHEMA = "doc_id long, text string, fp string, root int"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_edge_cases_match_brute_force(spark):
    texts = ["The cat sat", "the CAT  sat\n", None, "", " \t\x0b\x0c", "one", "one", "two words", "x\x1cy z w", "Ünï ß a b c", "a b c d " * 3000, "a b c d " * 3001]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == brute_groups(prints)
    assert got[2].component_id == got[3].component_id == got[4].component_id == 2


def test_empty_table_and_repeated_rows(spark):
    assert simhash.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(7, "same row", "", 0), (7, "same row", "", 0), (8, "other words here now", "", 0)]
    assert simhash.near_groups(spark.createDataFrame(rows, SCHEMA)).count() == 3
    assert sorted(r.doc_id for r in simhash.dedup(spark.createDataFrame(rows, SCHEMA)).collect()) == [7, 8]


@pytest.mark.parametrize("paired", [3, 64])
def test_links_of_crowded_variants(spark, monkeypatch, paired):
    """Many fingerprints near a few centres: pairs and stars must both give the brute-force components."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = np.random.default_rng(5)
    prints = set()
    for centre in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(30):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            prints.add(x - (1 << 64) if x >> 63 else x)
    wide = {p: p & (1 << 64) - 1 for p in prints}
    want = brute_groups(wide)
    root = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))).collect()}
    got = {p: root.get(p, p) for p in prints}
    assert sorted(map(sorted, _classes(got))) == sorted(map(sorted, _classes(want)))


def _classes(root):
    out = {}
    for k, v in root.items():
        out.setdefault(v, []).append(k)
    return out.values()
