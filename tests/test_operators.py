import json
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.operators import aggregate, dedup, distill, durable, extract, packing, providers, render, resume, stats, verify
from lorekeep.sources.schemas import CATEGORIES

FACT = "fact_ord long, fact string, category string, source_convo_id string, source_timestamp double, source_quote string"


def brute_pack(tokens, limit):
    out, chunk, used, open_ = [], -1, 0, False
    for t in tokens:
        if t > limit:
            chunk, open_ = chunk + 1, False
        elif open_ and used + t <= limit:
            used += t
        else:
            chunk, used, open_ = chunk + 1, t, True
        out.append(chunk)
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.integers(1, 25))
def test_next_fit_invariants(tokens, limit):
    state = packing.NextFit(limit)
    got = [state.put(t) for t in tokens]
    assert got == brute_pack(tokens, limit)
    assert sorted(set(got)) == list(range(len(set(got))))
    for c in set(got):
        own = [t for t, k in zip(tokens, got) if k == c]
        assert sum(own) <= limit or len(own) == 1


def test_pack_by_export(spark):
    rng = random.Random(2)
    rows = [(e, i, rng.randrange(40)) for e in ("x", "y") for i in range(300)]
    got = packing.pack(spark.createDataFrame(rows, "export string, part_ord long, tokens long").repartition(5), 50, "export").orderBy("export", "part_ord").collect()
    assert [r.chunk_id for r in got] == brute_pack([t for e, _, t in rows if e == "x"], 50) + brute_pack([t for e, _, t in rows if e == "y"], 50)


@settings(max_examples=40, deadline=None)
@given(st.text("ab.!? \n", max_size=900), st.integers(20, 60))
def test_split_text_loses_nothing_but_spaces(text, limit):
    parts = packing.split_text(text, limit)
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(parts)) == squeeze(text)
    assert all(packing.estimate(p) <= limit for p in parts)


def test_prepare_keeps_ids_and_names_parts(spark):
    conv = spark.createDataFrame([(0, "c0", "T", 0.0), (1, "c1", "S", 0.0)], "conv_ord long, id string, title string, create_time double")
    long = "word. " * 200
    msgs = [(0, "c0", 0, "m0", "user", "short", None, False), (0, "c0", 1, "m1", "assistant", long, None, False), (0, "c0", 2, "m2", "user", "end", None, False), (1, "c1", 0, "n0", "user", "hi", None, False)]
    messages = spark.createDataFrame(msgs, "conv_ord long, conv_id string, msg_ord int, id string, role string, content string, timestamp double, is_hidden boolean")
    rows = packing.prepare(conv, messages, render.render_conversations(conv, messages), 150).orderBy("conv_ord", "part_num").collect()
    assert {r.id for r in rows} == {"c0", "c1"} and [r.title for r in rows if r.id == "c1"] == ["S"]
    own = [r for r in rows if r.id == "c0"]
    assert [r.title for r in own] == [f"T (part {k})" for k in range(1, len(own) + 1)]
    assert own[0].message_id == "m0" and own[1].message_id == "m1_part1" and own[-1].message_id == "m2"
    with pytest.raises(ValueError):
        packing.split_messages(["x" * 999], 50)


def test_render(spark):
    conv = spark.createDataFrame([(0, "c0", "Title", 1.7e9)], "conv_ord long, id string, title string, create_time double")
    messages = spark.createDataFrame([(0, "c0", 1, "b", "assistant", "yes", 0.0, False), (0, "c0", 0, "a", "user", "ask", 86400.0, False)], "conv_ord long, conv_id string, msg_ord int, id string, role string, content string, timestamp double, is_hidden boolean")
    assert render.render_conversations(conv, messages).first().rendered == "=== Conversation: Title ===\nID: c0\nCreated: 1700000000.0\n\n[User (1970-01-02)]: ask\n\n[Assistant]: yes\n"
    assert render.conversation_text(messages).first().text == "ask\nyes"


def facts(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], FACT)


def test_aggregate_ties_and_order(spark):
    df = facts(spark, [("Likes  TEA", "a", "c1", 1.0, "q"), ("likes tea", "b", "c2", 5.0, "q"), ("Likes tea", "c", "c3", 5.0, "q"), ("other", "a", "c4", 2.0, "q"), ("It’s", "a", "c", 0.0, ""), ("it's", "a", "c", -1.0, "")])
    got = {r.norm: r for r in aggregate.aggregate_facts(df).collect()}
    tea = got["likes tea"]
    assert (tea.fact, tea.category, tea.frequency, tea.min_timestamp, tea.max_timestamp, tea.first_ord) == ("likes tea", "b", 3, 1.0, 5.0, 0)
    assert got["it's"].frequency == 2 and len(got) == 3
    assert aggregate.aggregate_facts(df.limit(0)).count() == 0
    assert [r.category for r in stats.category_breakdown(aggregate.aggregate_facts(df)).collect()][0] == "a"


TEXTS = [(0, "c0", "I adore the blue mountains of home and hike there"), (1, "c1", "My sister lives in Lyon since May"), (2, "c2", "we talked; i adore the blue mountains of home, again"), (3, "c3", "")]


def test_verify_order_and_reasons(spark):
    texts = spark.createDataFrame(TEXTS, "conv_ord long, conv_id string, text string")
    rows = [
        ("f", "x", "c0", 0.0, "the BLUE  mountains"),  # own, exact
        ("f", "x", "c1", 0.0, "my sistxr lives in lyon since may"),  # own, fuzzy
        ("f", "x", "c1", 0.0, "i adore the blue mountains"),  # elsewhere, first in order
        ("f", "x", "c9", 0.0, "my sister livez in lyon since may"),  # elsewhere, fuzzy
        ("f", "x", "c9", 0.0, "nothing of the kind was ever said here"),
        ("f", "x", "c0", 0.0, "  "),
        ("f", "x", "c0", 0.0, "no"),  # no words between, too short for runs
        ("f", "x", "c1", 0.0, "e"),
        ("f", "x", "c3", 0.0, "of home"),
        ("f", "x", None, 0.0, None),
    ]
    got = {r.fact_ord: r for r in verify.verify(facts(spark, rows), texts).collect()}
    assert len(got) == len(rows)
    want = ["own_exact", "own_fuzzy", "other_exact", "other_fuzzy", "discarded", "discarded", "discarded", "own_exact", "other_exact", "discarded"]
    assert [got[i].resolution for i in range(len(rows))] == want
    assert (got[2].source_convo_id, got[2].claimed_convo_id) == ("c0", "c1") and got[3].source_convo_id == "c1" and got[8].source_convo_id == "c0"
    assert got[5].match_location == "NOT FOUND - empty quote" and got[1].match_location.startswith("FOUND (fuzzy 9")
    lines = {r.fact_ord: r.line for r in verify.discarded(verify.verify(facts(spark, rows), texts)).collect()}
    assert lines[4].startswith("[conversation not found] Fact: 'f...'") and lines[5].startswith("[NOT FOUND]")
    off = {r.fact_ord: r.resolution for r in verify.verify(facts(spark, rows), texts, fuzzy=False).collect()}
    assert off[1] == off[3] == "discarded"
    assert {r.fact_ord for r in verify.corrections(verify.verify(facts(spark, rows), texts)).collect()} == {2, 3, 8}


def test_containing_is_containment(spark):
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(n))
    texts = [(i, say(rng.randrange(1, 30))) for i in range(60)]
    quotes = {t[a : a + rng.randrange(1, 14)].strip() for _, t in texts for a in [rng.randrange(len(t))]} | {"zz zz zz", "a"}
    quotes.discard("")
    found = verify.containing(spark.createDataFrame([(q,) for q in quotes], "quote string"), spark.createDataFrame(texts, "text_ord long, norm string"))
    assert sorted(map(tuple, found.collect())) == sorted((q, i) for q in quotes for i, t in texts if q in t)


def test_containing_by_bytes_without_words(spark):
    """Quotes of any length and alphabet, repeated passages, and a plan that neither lists the texts' words nor compares all pairs."""
    rng = random.Random(6)
    texts = [(i, "".join(rng.choice("aé€😀b ") for _ in range(rng.randrange(1, 90)))) for i in range(80)] + [(i, "very common line " * 40) for i in range(100, 130)]
    quotes = {t[a : a + rng.randrange(1, 40)] for _, t in texts for a in [rng.randrange(len(t))]} | {"é", "😀€", "common line very", "no such text at all", "x"}
    held = spark.createDataFrame(texts, "text_ord long, norm string")
    found = verify.containing(spark.createDataFrame([(q,) for q in quotes], "quote string"), held)
    assert sorted(map(tuple, found.collect())) == sorted((q, i) for q in quotes for i, t in texts if q in t)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "split(" not in plan
    assert verify.containing(spark.createDataFrame([], "quote string"), held).count() == 0


def test_resembling_gives_the_first_text(spark, monkeypatch):
    """Blocks of any size give the same, and no pair of a quote and a text becomes a row that is not a match."""
    texts = [(k, f"{k} and " + "the same long sentence is told in all of them " * (k % 3)) for k in range(12)]
    quotes = ["the samx long sentxnce is told", "nothing that was ever told here", "and the sime long sentence"]
    for size in (1 << 20, 20):
        monkeypatch.setattr(verify, "QUOTES_AT_ONCE", size)
        monkeypatch.setattr(verify, "TEXTS_AT_ONCE", 40 * size)
        found = verify.resembling(spark.createDataFrame([(q,) for q in quotes], "quote string"), spark.createDataFrame(texts, "text_ord long, norm string")).collect()
        assert sorted((r.quote, r.text_ord) for r in found) == [(quotes[2], 1), (quotes[0], 1)]


def test_dedup_counts_and_rounds(spark):
    rows = [(f"fact number {i} about topic {i * 7}", "a" if i < 60 else "b", "c", float(i), "") for i in range(75)] + [("fact number 3 about topic 21 !", "b", "c", 99.0, "")]
    merged = aggregate.aggregate_facts(facts(spark, rows))
    assert {(r.category, r.batch): r["count"] for r in dedup.batches(merged).groupBy("category", "batch").count().collect()} == {("a", 0): 50, ("a", 1): 10, ("b", 0): 16}
    assert dedup.deduplicate(merged).count() == 76  # the two never meet in one batch
    out = dedup.deduplicate(merged, size=100).collect()
    assert len(out) == 75 and "fact number 3 about topic 21 !" in {r.fact for r in out}
    calls = []

    def half(f):
        calls.append(len(f))
        return f.iloc[::2]

    frame = pd.DataFrame({"ord": range(120), "fact": "x", "category": "c", "period": ""})
    assert len(dedup.merge_sorted(frame, half)) <= 50 and max(calls) <= 50
    stuck = dedup.merge_sorted(frame, lambda f: f)
    assert len(stuck) == 120
    assert dedup.deduplicate(merged.limit(0)).count() == 0


def test_keep_best_equals_pair_by_pair(monkeypatch):
    """The same facts stay as by comparing sets one by one; a run without alike facts takes one comparison and no merge."""
    assert all(bool(dedup.WORD.fullmatch(chr(c))) == chr(c).isalnum() for c in range(0x110000))
    rng = random.Random(5)
    for size in (0, 1, 5, 50, 120):
        texts = ["".join(rng.choice(["a", "B", "c_d", "é1", "x-y", "", "!"]) + rng.choice([" ", "_", ". "]) for _ in range(rng.randrange(6))) for _ in range(size)]
        frame = pd.DataFrame({"ord": rng.sample(range(1000), size), "fact": pd.Series(texts, dtype=object), "category": "a", "period": pd.Series([rng.choice([None, "2020-01-01", "2021-05-05"]) for _ in texts], dtype=object)})
        sets = [frozenset("".join(c if c.isalnum() else " " for c in t.lower()).split()) for t in texts]
        kept = []
        for i in sorted(range(size), key=lambda i: ((frame["period"][i] or ""), len(texts[i]), -frame["ord"][i]), reverse=True):
            if not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in kept):
                kept.append(i)
        monkeypatch.setattr(dedup, "AT_ONCE", 1 if size == 50 else 1 << 19)
        assert dedup.keep_best(frame).index.tolist() == sorted(kept) and dedup.keep_best.idle(texts) == (len(kept) == size)


def test_dedup_rounds_are_bounded(spark):
    """A category far above the size of a batch: no call sees more than a batch, and rounds end with a merger that takes nothing away."""
    rows = [(f"word{i} other{i * 3} third{i * 7}", "a" if i % 3 else None, "c", float(i % 7), "") for i in range(230)]
    merged = aggregate.aggregate_facts(facts(spark, rows))

    def half(f):
        assert 0 < len(f) <= 10
        return f.iloc[::2]

    def settled(f):
        assert 0 < len(f) <= 10
        return f

    assert 0 < dedup.deduplicate(merged, half, 10).count() <= 10
    assert sorted(r.ord for r in dedup.deduplicate(merged, settled, 10, tasks=2).collect()) == list(range(230))
    placed = durable.numbered(merged, ["category"], ["source_timestamp", "first_ord"]).collect()
    for c in ("a", None):
        of = sorted((r for r in placed if r.category == c), key=lambda r: r["at"])
        assert [r["at"] for r in of] == list(range(len(of))) and of == sorted(of, key=lambda r: (r.source_timestamp, r.first_ord))


def test_extract_isolates_failures(spark):
    class Sometimes(providers.Offline):
        def complete_structured(self, prompt, schema):
            if "ID: c2" in prompt:
                raise RuntimeError("no")
            good = {"fact": "f", "category": "odd", "source_convo_id": "c", "source_timestamp": 1, "source_quote": "q"}
            return {"facts": [good, {"fact": "lacks keys"}, good | {"source_timestamp": "x"}]}

    chunks = spark.createDataFrame([(i, f"ID: c{i}\n[User]: hi") for i in range(5)], "chunk_id long, content string")
    got = extract.extract(chunks, Sometimes, 2)
    assert {r.chunk_id: r.status for r in got.collect()} == {0: "ok", 1: "ok", 2: "failed", 3: "ok", 4: "ok"}
    rows = extract.fact_rows(got).collect()
    assert sorted(r.chunk_id for r in rows) == [0, 1, 3, 4] and not any(r.category_valid for r in rows)
    assert [r.chunk_id for r in resume.remaining(chunks, resume.completed(got)).collect()] == [2]


def test_providers():
    assert [providers.max_concurrent(t) for t in (1000, 30_000, 80_000, 10**6)] == [1, 2, 5, 5] and providers.safe_chunk_size() == 8192
    now, slept = [0.0], []
    limit = providers.RateLimit(2, 1000, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        limit.take(10)
    assert slept == [60.1]
    limit.take(5000)
    assert len(slept) == 2
    tries, waits = [], []

    def fail():
        tries.append(1)
        raise OSError

    with pytest.raises(OSError):
        providers.with_retries(fail, lambda e: True, sleep=waits.append)
    assert len(tries) == 3 and waits == [5.0, 10.0]
    with pytest.raises(ValueError):
        providers.get_provider("none")

    class Fake(providers.Chat):
        def __init__(self, answer, local):
            super().__init__("", "", is_local=local)
            self.answer = answer

        def _post(self, prompt, schema):
            return self.answer

    ok = {"choices": [{"message": {"content": '{"facts": []}'}}]}
    assert Fake(ok, False).complete_structured("", {}) == {"facts": []}
    assert Fake({"choices": []}, True).complete("") == "" and Fake({"choices": []}, True).complete_structured("", {}) == {}
    for bad in ({"choices": []}, {"choices": [{"message": {"refusal": "no"}}]}, {"choices": [{"finish_reason": "length", "message": {"content": "x"}}]}, {"choices": [{"message": {"content": "  "}}]}, {"choices": [{"message": {"content": "{"}}]}):
        with pytest.raises(RuntimeError):
            Fake(bad, False).complete_structured("", {})


def test_profile_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "second", "values", ""), (1, "first", "values", "2020 to 2021"), (3, "who", "identity", ""), (4, "lost", "odd", "")], "ord long, fact string, category string, period string")
    made = distill.distill(df, source="s", generated="g")
    row = made.first()
    assert set(row.categories) == set(CATEGORIES) and row.fact_count == 4
    paths = distill.write_profile(made, str(tmp_path))
    assert open(paths[0]).read() == "# Memory Profile for User\n\n> Generated: g\n> Source: s\n\n## Identity\n\n- who\n\n## Values\n\n- first *(2020 to 2021)*\n- second\n\n"
    data = json.load(open(paths[1]))
    assert list(data) == ["name", "generated", "source", "categories"] and data["categories"]["growth"] == []
    assert distill.write_profile(None, str(tmp_path)) == []
    assert [r.n for r in stats.profile_summary(df.filter("category != 'odd'")).collect()] == [1, 2, 0, 0, 0, 0, 0, 0, 3]
    assert distill.distill(df.limit(0)).first().fact_count == 0


def test_summaries(spark):
    df = facts(spark, [("a", "x", "c", 1.0, ""), ("A", "x", "c", 2.0, ""), ("b", "y", "c", 1.0, "")])
    merged = aggregate.aggregate_facts(df)
    assert sorted(map(tuple, stats.category_summary(merged).collect())) == [("TOTAL", 2, 3), ("x", 1, 2), ("y", 1, 1)]
    assert sorted((r.category, r.n_before, r.n_after, r.percent) for r in stats.reduction_summary(df, merged).collect()) == [("TOTAL", 3, 2, 33.3), ("x", 2, 1, 50.0), ("y", 1, 1, 0.0)]
    calls = spark.createDataFrame([(4, 2, 1.0), (2, 2, 3.0)], "n_in long, n_out long, seconds double")
    assert tuple(stats.call_stats(calls).first()) == (2, 6, 4, 4.0, 3.0, 2.0)
    assert stats.frequency_histogram(merged).first().twice == 1
    assert F is not None
