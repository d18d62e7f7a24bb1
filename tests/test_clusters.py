import numpy as np

from lorekeep.operators import dedup


def test_clusters_are_components_of_all_pairs(spark):
    """Groups of ten, chains, and vectors that link to none, against brute force."""
    rng = np.random.default_rng(3)
    rows = [c + 0.4 * rng.normal(size=24) / np.sqrt(24) * np.linalg.norm(c) for c in rng.normal(size=(30, 24)) for _ in range(10)]
    turn = np.zeros((9, 24))
    turn[:, 0], turn[:, 1] = np.cos(np.arange(9) / 2.2), np.sin(np.arange(9) / 2.2)  # each like the next alone
    v = np.concatenate([rows, turn])[rng.permutation(309)]
    near = (v @ v.T) / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1)) >= 0.85
    want = np.arange(len(v))
    while (now := np.where(near, want[None, :], len(v)).min(axis=1)).tolist() != want.tolist():
        want = now
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 24), (902, [])]
    got = {r.id: r.cluster for r in dedup.cluster_by_embedding(spark.createDataFrame(data, "id long, embedding array<double>"), block=100).collect()}
    assert got == dict(enumerate(want.tolist())) | {i: i for i in (900, 901, 902)} and len(set(want)) < 200


def test_shuffle_grows_no_faster_than_the_rows(spark, monkeypatch):
    """More rows go into larger blocks: each meets as many as before, and the clusters are those of any blocks."""
    rng = np.random.default_rng(4)
    v = np.concatenate([c + 0.2 * rng.normal(size=(6, 8)) for c in rng.normal(size=(40, 8))]).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>")
    want = {r.id: r.cluster for r in dedup.cluster_by_embedding(table).collect()}
    asked = []
    pmod = dedup.F.pmod
    monkeypatch.setattr(dedup, "VECTORS", 5)
    monkeypatch.setattr(dedup, "BLOCKS", 3, raising=False)
    monkeypatch.setattr(dedup, "COMPARED", 4, raising=False)
    monkeypatch.setattr(dedup.F, "pmod", lambda a, b: asked.append(str(b)) or pmod(a, b))
    assert {r.id: r.cluster for r in dedup.cluster_by_embedding(table).collect()} == want
    assert any("'3'" in x for x in asked)  # not a block for every 5 rows
