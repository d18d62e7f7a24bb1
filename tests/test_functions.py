import random
import re
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.functions import fuzzy
from lorekeep.functions import text as fn


def plain_norm(t):
    for a, b in [("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("—", "-"), ("–", "-"), ("…", "...")]:
        t = (t or "").replace(a, b)
    return re.sub(r"\s+", " ", t.lower()).strip()


def test_normalize(spark):
    texts = ["  Hello\t\nWORLD ", "It’s “so” — well – fine…", "Café", "a b c　d\u0085e f", "x\x1cy\x1dz\x1e\x1f", None, "", "   ", "ÄÖÜ"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fn.normalize_text("t").alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: plain_norm(t) for i, t in enumerate(texts)}


def test_formats(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    size = {0: "0 bytes", 1023: "1023 bytes", 1024: "1.0 KB", 1048576: "1.00 MB", 1073741824: "1.00 GB"}
    assert all(one(fn.human_size(F.lit(b))) == s for b, s in size.items())
    elapsed = {5.0: "5.0s", 90.0: "1m 30s", 3661.0: "1h 1m", 59.94: "59.9s"}
    assert all(one(fn.human_elapsed(F.lit(s))) == t for s, t in elapsed.items())
    assert one(fn.truncate(F.lit("abcdef"), 4)) == "abcd..." and one(fn.truncate(F.lit("abcd"), 4)) == "abcd"
    assert one(fn.period(F.lit(0.0), F.lit(86400.0))) == "1970-01-01 to 1970-01-02"
    assert one(fn.plain_number(F.lit(1.7e9))) == "1700000000.0" and one(fn.plain_number(F.lit(0.25))) == "0.25"
    assert one(fn.percent_reduced(F.lit(4), F.lit(1))) == 75.0 and one(fn.percent_reduced(F.lit(0), F.lit(0))) == 0.0
    assert one(fn.capital(F.lit("aSSistant"))) == "Assistant" and one(fn.token_estimate(F.lit("abcde"))) == 2


def brute_fuzzy(quote, text, threshold=0.85):
    if not quote or not text or len(quote) > len(text):
        return None
    best, found = max(threshold, 0.9) if len(quote) < 20 else threshold, None
    for size in range(max(10, len(quote) - 10), min(len(text) + 1, len(quote) + 20)):
        for a in range(0, len(text) - size + 1, 5):
            r = SequenceMatcher(None, quote, text[a : a + size]).ratio()
            if r > best:
                best, found = r, text[a : a + size]
    return None if found is None else (found, best)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**9))
def test_fuzzy_is_the_plain_search(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("abcde ") for _ in range(rng.randrange(20, 90)))
    a = rng.randrange(len(text) - 12)
    quote = list(text[a : a + rng.randrange(8, 40)])
    for _ in range(rng.randrange(4)):
        quote[rng.randrange(len(quote))] = rng.choice("xyz")
    got = fuzzy.fuzzy_find("".join(quote), text)
    assert got == brute_fuzzy("".join(quote), text)
    if got:
        q = "".join(quote)
        grams = {text[i : i + 3] for i in range(len(text) - 2)}
        assert sum(q[i : i + 3] in grams for i in range(len(q) - 2)) >= fuzzy.shared_grams_needed(len(q))


@pytest.mark.parametrize("quote,hit", [("i love hiking in the mountans", True), ("completely different words here now", False), ("", False)])
def test_fuzzy_examples(quote, hit):
    assert bool(fuzzy.fuzzy_find(quote, "last year i said i love hiking in the mountains every summer")) is hit


@pytest.mark.parametrize("seed", range(12))
def test_fuzzy_with_insertions_and_deletions(seed):
    rng = random.Random(seed)
    whole = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30))
    longer = list(whole)
    for k in sorted(rng.sample(range(1, 30), 6 + seed % 3), reverse=True):
        longer.insert(k, rng.choice("0123456789"))
    longer = "".join(longer)
    for quote, text in ((whole, "-----" + longer + "-----"), (longer, "-----" + whole + "-" * 15)):
        want = brute_fuzzy(quote, text)
        assert fuzzy.fuzzy_find(quote, text) == want
        if want:
            grams = {text[i : i + 3] for i in range(len(text) - 2)}
            assert sum(quote[i : i + 3] in grams for i in range(len(quote) - 2)) >= fuzzy.shared_grams_needed(len(quote))
    assert brute_fuzzy(whole, "-----" + longer + "-----")


def test_quotes_looked_for_together():
    """Quotes of one piece and of several, near the ends and inside, against the plain search of each."""
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = [say(rng.randrange(0, 300)) for _ in range(25)] + ["", "é€😀" * 20]
    quotes = ["é€😀é€😀é€😀é€", ""]
    for _ in range(60):
        text = rng.choice(texts[:25])
        a = rng.randrange(len(text) + 1)
        quote = list(text[a : a + rng.randrange(5, 150)])
        for _ in range(rng.randrange(8)):
            quote.insert(rng.randrange(len(quote) + 1), rng.choice("abx"))
        quotes.append("".join(quote))
    for text in texts:
        asked = fuzzy.Quotes(quotes, at_once=7)
        found = {asked.quotes[i]: (window, ratio) for i, window, ratio in asked.find(text)}
        assert found == {q: x for q in quotes if (x := brute_fuzzy(q, text))}


@pytest.mark.parametrize("longest", [8192, 30])
def test_few_quotes_reach_the_edit_count(monkeypatch, longest):
    """Texts of common syllables, some empty or over several sections: the first with a window, as in the plain search, and few edits counted."""
    rng = random.Random(4)
    parts = ["th", "he", "an", "in", "er", "rin", "on", "ti", "ing", "ble", "sou", "dwa", "lym", "fac", "pok", "vug", "and ", "the ", "of ", " ", ", "]
    say = lambda n: "".join(rng.choice(parts) for _ in range(n))
    texts = [say(rng.choice([0, 5, 60, 300])) for _ in range(24)]
    quotes = []
    for k in range(60):
        text = rng.choice([t for t in texts if len(t) > 99])
        a = rng.randrange(len(text) - 80)
        quote = list(text[a : a + rng.randrange(20, 80)])
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(quote))
            quote[at : at + rng.randrange(2)] = rng.choice(["", "x", "an"])
        quotes.append("".join(quote) if k % 3 else "".join(quote).replace("e", "x"))
    counted, plain = [], fuzzy._nearest
    monkeypatch.setattr(fuzzy, "LONGEST", longest)
    monkeypatch.setattr(fuzzy, "_nearest", lambda *a: counted.append(len(a[1])) or plain(*a))
    asked = fuzzy.Quotes(quotes)
    found = {asked.quotes[i]: (k, window, ratio) for k, i, window, ratio in asked.find_all(texts)}
    want = {}
    for q in quotes:
        for k, t in enumerate(texts):
            if x := fuzzy.fuzzy_find(q, t):
                want[q] = (k, *x)
                break
    assert found == want and len(want) > 20
    if longest > 80:
        assert sum(counted) < 0.6 * len(quotes) * len(texts)
