import importlib.util
import random
from pathlib import Path

import corpus_pipeline
from lorekeep.llm import decontaminate, toxicity


def brute_of(name):
    path = Path(__file__).with_name(f"test_{name}.py")
    spec = importlib.util.spec_from_file_location(path.stem, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def tables(spark, folder):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randrange(8, 20))) for i in range(12)]
    rows, labels = [], []
    for i in range(240):
        text = "\n".join(say(rng.randrange(4, 20)) for _ in range(rng.randrange(1, 5)))
        kind = i % 12
        if kind in (0, 1, 2):
            text += " utterly vilest " + say(3)
        elif kind == 3:
            text += "\n" + items[i % len(items)][1]
        elif kind == 4 and rows:
            text = rows[rng.randrange(len(rows))][1]
        labels.append((i, 1, int(kind < 3)))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(900, None, None, None, None), (901, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = tables(spark, tmp_path)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fitted(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.scores(docs, model).filter(f"score >= {toxicity.REJECT}").collect()}
    assert {i for i, t, *_ in rows if t and "vilest" in t} == bad
    left = {i: t for i, t, *_ in rows if i not in bad}
    gone = brute_of("linededup").brute(list(left.items()))
    left = {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in left.items()}
    simhash = brute_of("simhash")
    groups = simhash.brute_groups({i: simhash.brute_print(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if groups[i] == i}
    hit = {d for d, _, n, _ in brute_of("decontaminate").brute(list(left.items()), items) if n}
    left = {i: t for i, t in left.items() if i not in hit}
    assert {i: r.text for i, r in out.items()} == left
    assert sorted(r.position for r in out.values()) == list(range(len(left)))
    assert all(r.n_chars == len(r.text) for r in out.values() if r.text is not None)


def test_stage_columns(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(5), str(tmp_path)).columns == docs.columns
    assert decontaminate.WINDOW == 10 and corpus_pipeline.ORACLE_SQL is None
