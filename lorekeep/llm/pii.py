"""Personal data by aggregated weak supervision.

Rules find base spans. Wider candidates (numbers and addresses of looser shapes) are put before labelers: regular
expressions, gazetteers and context, which vote for, against or not at all. Expectation-maximisation over the counts of
vote patterns of all documents estimates each labeler's reliability, with base spans as known positives and matches that
break a base rule as known negatives; a logistic classifier of the patterns is trained on the posteriors and decides the
remaining candidates. What it accepts is added; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import slices, stored

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
#: A candidate is added from this probability on.
ACCEPT = 0.9
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile("[0-9]")
#: Greedy runs of digits need no second try from within, which the look-behind and the possessive runs spare.
IPS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARDS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONES = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser shapes, for candidates only.
LOOSE_MAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]{2,63}){1,4}")
LOOSE_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
LOOSE_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9]|[.\x20-][0-9])")
# Fixed values of the gazetteers: top-level domains, country calling codes, first digits of card issuers.
DOMAINS = frozenset("com org net edu gov mil int io co uk de fr es it nl eu us ca au jp cn br in ch at be se no dk fi pl pt ru info biz".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92")
ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "64", "65")
# Words that announce a kind.
CUES = [("mail", "contact", "write"), ("ip", "host", "server", "address"), ("card", "visa", "master", "credit", "pay"), ("tel", "phone", "call", "mobile", "fax", "cell")]
LABELERS = ("shape", "valid", "gazetteer", "context", "edges")
BASE, BROKEN, OPEN = range(3)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, each found from its @: linear even in very long runs."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    return out


def matched(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the base spans, and of matches that break their kind's rule narrowly."""
    base, broken = [(EMAIL, *x) for x in emails(text)] if "@" in text else [], []
    if DIGIT.search(text) is None:
        return base, broken
    for m in IPS.finditer(text):
        good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
        (base if good else broken).append((IP, *m.span()))
    for m in CARDS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19:
                (base if luhn(digits) else broken).append((CARD, *m.span()))
    if "+" in text:
        for m in PHONES.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            if 10 <= n <= 15:
                base.append((PHONE, *m.span()))
            elif 7 <= n <= 18:
                broken.append((PHONE, *m.span()))
    return base, broken


def loose(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of looser shapes that no base span touches."""
    found = []
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        found += [(EMAIL, *m.span()) for m in LOOSE_MAIL.finditer(text)]
    if text.count(":") >= 7:
        found += [(IP, *m.span()) for m in LOOSE_IP.finditer(text)]
    if DIGIT.search(text):
        found += [(PHONE, *m.span()) for m in LOOSE_PHONE.finditer(text)]
    return [x for x in found if not any(a < x[2] and x[1] < b for _, a, b in base)]


def votes(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote: 2 for, 0 against, 1 none; in the order of LABELERS."""
    span = text[start:end]
    digits = re.sub("[^0-9]", "", span)
    last = re.split(r"[^A-Za-z0-9]+", span)[-1].lower()
    if kind == EMAIL:
        shape, valid, known = 2 if "@" in span else 1, 2 if last.isalpha() and len(last) >= 2 else 0, 2 if last in DOMAINS else 0
    elif kind == IP:
        parts = span.split(".")
        shape = 2 if len(parts) == 4 and all(len(p) <= 3 for p in parts) else 1
        valid = 2 if ":" in span or all(len(p) <= 3 and int(p) <= 255 for p in parts) else 0
        known = 0 if ":" not in span and parts[0].lstrip("0") in ("", "255") else 1
    elif kind == CARD:
        shape = 2 if span == digits or re.fullmatch(r"[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}", span) else 0
        valid, known = 2 if luhn(digits) else 0, 2 if digits.startswith(ISSUERS) else 1
    else:
        shape = 2 if re.fullmatch(r"\+?[0-9]{0,3}[\x20.-]?(\([0-9]{2,4}\)|[0-9]{2,4})([\x20.-][0-9]{2,4})+", span) else 1
        valid, known = 2 if 10 <= len(digits) <= 15 else 0, (2 if digits.startswith(CALLING) else 0) if span[0] == "+" else 1
    before = text[max(0, start - 32) : start].lower()
    context = 2 if any(c in before for c in CUES[kind]) else 1
    out = text[start - 1 : start] + text[end : end + 1]
    return shape, valid, known, context, 0 if any(c.isalnum() for c in out) else 2


def _finder(batches):
    item = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    wide = pa.struct([*item, pa.field("pattern", pa.int32())])
    for b in slices(batches):
        base_of, open_of, counts, patterns = [], [], [], []
        for text in b.column(1).to_pylist():
            text = text or ""
            base, broken = matched(text)
            spans = sorted((s, k, e) for k, s, e in base)
            base_of.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            rest = loose(text, base)
            coded = [(what, k, s, e, _code(k, votes(text, k, s, e))) for what, group in ((BASE, base), (BROKEN, broken), (OPEN, rest)) for k, s, e in group]
            open_of.append([{"start": s, "kind": k, "end": e, "pattern": c} for what, k, s, e, c in coded if what == OPEN])
            patterns.append([c * 3 + what for what, _, _, _, c in coded])
            counts.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base_of, pa.list_(item)), pa.array(open_of, pa.list_(wide)), pa.array(patterns, pa.list_(pa.int32())), pa.array(counts)], ["doc_id", "base", "open", "patterns", "base_sha256"])


def _code(kind: int, vote: tuple[int, ...]) -> int:
    for v in vote:
        kind = kind * 3 + v
    return kind


def _decode(code: int) -> tuple[int, list[int]]:
    vote = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        vote.append(v)
    return code, vote[::-1]


def aggregate(counts: dict[tuple[int, int], int], rounds: int = 50) -> tuple[dict[int, float], np.ndarray]:
    """From (pattern, BASE | BROKEN | OPEN) -> count: each pattern's probability under the span classifier, and reliabilities [true, labeler, vote]."""
    if not counts:
        return {}, np.full((2, len(LABELERS), 3), 1 / 3)
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    of = np.array([what for _, what in keys])
    kind = np.array([_decode(c)[0] for c, _ in keys])
    vote = np.array([_decode(c)[1] for c, _ in keys])
    one = np.eye(3)[vote]
    # Start: known labels, and for open ones the share of votes for among those given.
    y = np.where(of == BASE, 1.0, np.where(of == BROKEN, 0.0, ((vote == 2).sum(1) + 0.5) / ((vote != 1).sum(1) + 1)))
    prior = (10 + 0.05 * n.sum()) * np.array([[0.7, 0.25, 0.05], [0.05, 0.25, 0.7]])[:, None]  # labelers are better than chance
    for _ in range(rounds):
        like = np.stack([((n * (1 - y))[:, None, None] * one).sum(0), ((n * y)[:, None, None] * one).sum(0)]) + prior
        like /= like.sum(axis=2, keepdims=True)
        share = ((n * y).sum() + 1) / (n.sum() + 2)
        log = np.log(share / (1 - share)) + np.log(like[1] / like[0])[np.arange(len(LABELERS)), vote].sum(axis=1)
        now = np.where(of == OPEN, 1 / (1 + np.exp(-np.clip(log, -30, 30))), y)
        if np.abs(now - y).max() < 1e-9:
            break
        y = now
    x = np.concatenate([one.reshape(len(keys), -1), np.eye(len(KINDS))[kind], np.ones((len(keys), 1))], axis=1)
    w = np.zeros(x.shape[1])
    against = np.concatenate([np.tile([1.0, 0, 0], len(LABELERS)), np.full(len(KINDS), 1 / len(KINDS)), [1.0]])
    x, y, n = np.concatenate([x, against[None]]), np.concatenate([y, [0.0]]), np.concatenate([n, [100.0]])  # all against: no span
    weight = np.sqrt(n)  # so that frequent patterns do not drown the others
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 0.1 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(curve, slope), -2, 2)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {c: float(q) for (c, _), q in zip(keys, p.tolist(), strict=False)}, like


def find(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, base, spans: arrays of (start, kind, end); base_sha256) of each document row.

    kind is a place in KINDS; places are code points, end exclusive. A null or empty text has no spans. Repeated rows
    keep a row each; extra columns are ignored; an empty table gives an empty result.
    """
    found = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_finder, "doc_id long, base array<struct<start:int,kind:int,end:int>>, open array<struct<start:int,kind:int,end:int,pattern:int>>, patterns array<int>, base_sha256 string"))
    counts = found.select(F.explode("patterns").alias("p")).groupBy("p").count().collect()  # at most 3 * 4 * 3^5 rows
    chance, _ = aggregate({(r.p // 3, r.p % 3): r["count"] for r in counts})
    good = sorted(c for c, p in chance.items() if p >= accept)
    added = F.transform(F.filter("open", lambda x: x["pattern"].isin(good)), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"), "base_sha256")
