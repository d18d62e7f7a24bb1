import hashlib
import random
import re

from lorekeep.llm import pii, queries

SCHEMA = "doc_id long, text string, base string, kind int"


def plain_luhn(d):
    v = [int(c) for c in d][::-1]
    return (sum(v[::2]) + sum(sum(divmod(2 * x, 10)) for x in v[1::2])) % 10 == 0


def brute(text):
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and plain_luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_match_brute_force():
    rng = random.Random(7)
    for _ in range(6000):
        text = "".join(rng.choice("a1290..@@+-() %é\n") for _ in range(rng.randrange(60)))
        assert sorted((s, k, e) for k, s, e in pii.matched(text)[0]) == brute(text), text
    for text in ("4111 1111 1111 1111", "4111-1111-1111-1111 5500005555555559", "a@b.c.d@e.f", "x@@y.z w@v", "1.2.3.4.5.6.7.8", "999.1.1.1.2.3.4", "+1 (980) 555-6268.", "000000000000000001.1.1.1"):
        assert sorted((s, k, e) for k, s, e in pii.matched(text)[0]) == brute(text), text


def test_documents(spark):
    card = "4111111111111111"
    texts = [None, "", "plain words", f"ümail: bob.1@mail.example.com, card {card}!", "ip 10.0.0.1 and 300.1.1.1", "call +1 (980) 555-6268 now", f"not luhn {card[:-1]}2", "x" * 3000 + " a@b.co", "a" * 100_000 + "@" + "1" * 100_000]
    rows = [(i, t, "clash", 9) for i, t in enumerate(texts)] + [(3, texts[3], "", 0)]
    got = pii.find(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(texts[r.doc_id]) if r.doc_id != 8 else []
        assert [tuple(x) for x in r.base] == want
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want).encode()).hexdigest()
    assert pii.find(spark.createDataFrame([], SCHEMA)).count() == 0


def test_reliabilities_are_learned():
    """Labelers that agree with the known spans become reliable, and open candidates follow them."""
    code = lambda *v: pii._code(3, v)
    counts = {(code(2, 2, 2, 2, 2), pii.BASE): 500, (code(2, 2, 1, 1, 2), pii.BASE): 300, (code(1, 0, 0, 1, 2), pii.BROKEN): 400, (code(2, 0, 1, 1, 0), pii.BROKEN): 200, (code(2, 2, 1, 2, 2), pii.OPEN): 40, (code(1, 0, 1, 1, 0), pii.OPEN): 40}
    chance, like = pii.aggregate(counts)
    assert chance[code(2, 2, 1, 2, 2)] > pii.ACCEPT and chance[code(1, 0, 1, 1, 0)] < 0.1
    assert like[1, 1, 2] > 0.9 and like[0, 1, 0] > 0.9
    assert pii.aggregate({})[0] == {}


def test_loose_shapes(spark):
    rows = [(i, f"tel (980) 555-62{i:02d} and bob@ex.com or +1 (980) 555-6268", "", 0) for i in range(60)]
    got = pii.find(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all([pii.KINDS[s.kind] for s in r.spans] == ["phone", "email", "phone"] for r in got)


def test_query_counts_each_kind(spark, tmp_path):
    """Spans of every kind in any order and number, through the query."""
    rng = random.Random(4)
    parts = ["bob@ex.com", "10.0.0.1", "4111111111111111", "+1 (980) 555-6268", "plain", "300.1.1.1", "4111111111111112"]
    texts = [None, "", *(" ; ".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(60))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op9_pii(spark, str(tmp_path)).collect():
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want).encode()).hexdigest()
