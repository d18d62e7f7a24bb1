import math

import numpy as np

from lorekeep.llm import maxscore

SCHEMA = "vec_id long, embedding array<float>, v string"


def brute(rows, queries, k):
    good = {}
    for i, x, *_ in rows:
        if i is not None and x is not None and all(y is not None and math.isfinite(y) for y in x):
            good.setdefault(i, []).append([math.floor(1024 * float(np.float32(y))) for y in x])
    out = []
    for q in queries:
        if q in good:
            v = min(good[q])
            found = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, xs in good.items() for x in xs if i != q and len(x) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def got(spark, rows, k=10, **more):
    table = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, maxscore.search(table, table.filter("vec_id % 100 = 0"), k, **more).collect()))


def test_matches_brute_force_with_ties_nulls_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 64)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 16).astype(np.float32).tolist(), "x") for i in range(420)]
    rows += [(1000 + i, rows[3][1], "tie") for i in range(15)]
    rows += [(500, None, ""), (600, [None] * 16, ""), (700, [float("nan")] * 16, ""), (800, [float("inf")] + [0.0] * 15, ""), (900, [1.0], ""), (901, [2.0], ""), (None, [1.0], ""), (903, [], "")]
    want = brute(rows, range(0, 1100, 100), 10)
    assert got(spark, rows) == want
    assert got(spark, rows, block=2) == want


def test_empty_and_few(spark):
    assert got(spark, []) == []
    assert got(spark, [(100, [1.0, 2.0], ""), (1, [0.5, -1e6], "")]) == [(100, 1, 1, 1024 * 512 - 2048 * 1024 * 10**6)]


def test_queries_outside_the_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 8).tolist(), "") for i in range(200)]
    asked = [(10**6 + i, rng.normal(0, 3.0, 8).tolist(), "") for i in range(30)]  # they score each other far higher
    found = maxscore.search(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, SCHEMA), 10).collect()
    of = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v, _ in rows + asked}
    want = [(q, r + 1, i, -s) for q, *_ in asked for r, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(of[q], of[i])), i) for i, *_ in rows)[:10])]
    assert sorted(map(tuple, found)) == sorted(want)
