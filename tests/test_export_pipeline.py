import json
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.tokens import Vocabulary
from lorekeep.operators import distill, extract, providers, render
from lorekeep.plans import pipeline
from lorekeep.sources.schemas import CATEGORIES
from lorekeep.streaming import ingest

DATA = [{"uuid": f"u{i}", "name": f"Talk {i}", "created_at": "2024-01-02T03:04:05Z", "chat_messages": [{"uuid": f"m{i}{k}", "sender": "human" if k % 2 == 0 else "assistant", "text": f"I like topic {i}{k} a lot. More words follow.", "created_at": "2024-01-02T03:04:05Z"} for k in range(4)]} for i in range(6)]


def test_export_to_profile_and_resume(spark, tmp_path):
    (tmp_path / "export.json").write_text(json.dumps(DATA))
    (tmp_path / "memories.json").write_text(json.dumps([{"conversations_memory": "likes tea"}]))
    s = pipeline.Settings(str(tmp_path / "export.json"), str(tmp_path / "state"), str(tmp_path / "out"), chunk_tokens=120)
    got = pipeline.run(spark, s)
    assert got["kind"] == "claude" and got["trusted"] == "likes tea" and got["chunks"].count() > 1
    assert dict(got["counts"])["facts"] == 12 == dict(got["counts"])["verified"]
    assert "I like topic 00 a lot." in open(got["paths"][0]).read()
    again = pipeline.run(spark, s)
    assert again["counts"] == got["counts"]
    demo = pipeline.run(spark, pipeline.Settings(s.source, s.folder, s.output, demo=True))
    assert demo["chunks"].count() == 1


def counting(folder):
    """Makes a provider that answers like a model, and notes each prompt in a folder. It travels to the workers by value."""

    class Counting(providers.Offline):
        is_local = False

        def complete_structured(self, prompt, schema):
            open(f"{folder}/{uuid.uuid4().hex}", "w").write(prompt)
            if "categories" in schema["properties"]:
                facts = json.loads(prompt[prompt.index("[{") :])
                return {"name": "Ada", "categories": {c: [{"fact": f["fact"].upper(), "period": f["period"]} for f in facts if f["category"] == c] for c in CATEGORIES[:4]}}
            if "source_quote" in schema["properties"]["facts"]["items"]["properties"]:
                return super().complete_structured(prompt, schema)
            return {"facts": json.loads(prompt[prompt.index("[\n") :])}

    return Counting


def test_model_is_asked_once(spark, tmp_path, monkeypatch):
    """Distillation by a provider keeps the baseline; a second run finds every stage and asks nothing."""
    monkeypatch.setattr(pipeline, "WAVE", 2)
    asked = tmp_path / "asked"
    asked.mkdir()
    (tmp_path / "export.json").write_text(json.dumps(DATA))
    (tmp_path / "memories.json").write_text(json.dumps([{"conversations_memory": "likes tea"}]))
    s = pipeline.Settings(str(tmp_path / "export.json"), str(tmp_path / "state"), str(tmp_path / "out"), "local", chunk_tokens=120)
    monkeypatch.setattr(pipeline.Settings, "maker", lambda self: counting(str(asked)))
    got = pipeline.run(spark, s)
    prompts = [p.read_text() for p in asked.iterdir()]
    assert sum("likes tea" in p for p in prompts) == 1 and sum(p.startswith(extract.EXTRACT_PROMPT) for p in prompts) == got["chunks"].count()
    row = got["profile"].first()
    assert row.name == "Ada" and row.fact_count == got["deduped"].count() == 12 and set(row.categories) == set(CATEGORIES)
    assert {f.fact for c in CATEGORIES[:4] for f in row.categories[c]} == {r.fact.upper() for r in got["deduped"].filter(F.col("category").isin(CATEGORIES[:4])).collect()}
    assert pipeline.run(spark, s)["profile"].first() == row and len(list(asked.iterdir())) == len(prompts)


def test_settings_follow_the_provider():
    of = lambda p, **o: pipeline.Settings("s", "f", provider=p, chunk_tokens=500, **o)
    assert [of("offline").limit, of("local").limit, of("api").limit, of("api", demo=True).limit] == [500, 500, 8192, 4096]
    assert [of("local").calls, of("api").calls, of("api", tpm=80_000).calls] == [1, 2, 5]
    made = [of("api", options={"url": "u", "model": "m"}).maker()() for _ in range(2)]
    assert made[0].limit is made[1].limit and (made[0].limit.rpm, made[0].limit.tpm) == (2, 15_000)
    assert of("local", options={"url": "u", "model": "m"}).maker()().limit is None
    with pytest.raises(FileNotFoundError):
        extract.prompt_file("/nowhere/prompt.txt")


def test_distillation_in_runs(spark, tmp_path):
    df = spark.createDataFrame([(i, f"f{i}", CATEGORIES[i % 3], "") for i in range(7)], "ord long, fact string, category string, period string")
    folder = str(tmp_path)
    made = distill.distill_by(df, counting(folder), "base", at_once=3).first()
    prompts = [p.read_text() for p in tmp_path.iterdir()]
    assert len(prompts) == 3 and sum("base" in p for p in prompts) == 1 and made.fact_count == 7
    assert [[f.fact for f in made.categories[c]] for c in CATEGORIES[:3]] == [[f"F{i}" for i in range(k, 7, 3)] for k in range(3)]
    empty = distill.distill_by(df.limit(0), counting(folder)).first()
    assert empty.fact_count == 0 and empty.name == "User" and len(list(tmp_path.iterdir())) == 3


def test_chunks_by_a_vocabulary(spark):
    """Counts of a small vocabulary made here: no chunk has more tokens than the limit."""
    tokenizers = pytest.importorskip("tokenizers")
    words = {w: i for i, w in enumerate(["?", "I", "like", "topic"])}
    made = tokenizers.Tokenizer(tokenizers.models.WordLevel(words, unk_token="?"))
    made.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    with tempfile.TemporaryDirectory() as folder:
        made.save(f"{folder}/v.json")
        count = Vocabulary(f"{folder}/v.json")
        assert [count("I like  topic 7."), count(""), count(None)] == [5, 0, 0]
        kept = spark.createDataFrame([(1, "I like it"), (2, None)], "i int, t string").select("i", count.column("t").alias("n"))
        assert {r.i: r.n for r in kept.collect()} == {1: 3, 2: 0}
        conversations = spark.createDataFrame([(i, f"c{i}", "t", 0.0) for i in range(4)], "conv_ord long, id string, title string, create_time double")
        messages = spark.createDataFrame([(i, f"c{i}", k, f"m{k}", "user", "I like topic " * 20, 0.0, False) for i in range(4) for k in range(3)], "conv_ord long, conv_id string, msg_ord int, id string, role string, content string, timestamp double, is_hidden boolean")
        rows = pipeline.chunked(conversations, messages, 150, count).collect()
        assert len(rows) > 4 and all(count(r.content) == r.tokens <= 150 for r in rows)


def test_streaming_ingestion(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    args = (spark, str(inbox), str(tmp_path / "tables"), str(tmp_path / "ck"))
    (inbox / "a.json").write_text(json.dumps(DATA[:2]))
    ingest.ingest(*args).awaitTermination()
    (inbox / "b.json").write_text(json.dumps(DATA[2:]))
    ingest.ingest(*args).awaitTermination()
    assert ingest.read_table(spark, str(tmp_path / "tables"), "messages").count() == 24
    ingest.ingest(*args).awaitTermination()
    found = [ingest.read_table(spark, str(tmp_path / "tables"), n) for n in ("conversations", "messages")]
    assert found[0].count() == 6 == found[0].select("conv_ord").distinct().count()
    shown = render.render_conversations(*found).collect()
    assert all(f"topic {r.id[1]}{k} " in r.rendered for r in shown for k in range(4)) and all(r.rendered.count("I like topic") == 4 for r in shown)


def test_log_has_every_discarded_fact(spark, tmp_path):
    checked = spark.range(10_050).selectExpr("id AS fact_ord", "concat('fact ', id) AS fact", "'quote' AS source_quote", "'c' AS claimed_convo_id", "true AS has_text", "IF(id % 1000 = 7, 'own_exact', 'discarded') AS resolution")
    text = open(pipeline.write_log(checked, str(tmp_path))).read()
    left = [i for i in range(10_050) if i % 1000 != 7]
    assert text == "\n".join(f"[NOT FOUND] Fact: 'fact {i}...'\n  Quote: 'quote...'\n  Conversation: c" for i in left)
    assert open(pipeline.write_log(checked.limit(0), str(tmp_path))).read() == ""
