"""Splitting long conversations and packing parts into token-bounded chunks.

Packing is next-fit: it depends on order and on all before it in its export. Only (order, tokens) goes through the
fold, streamed in sorted order with a state of two numbers; texts stay where they are. Exports pack independently, and
so in parallel, when `by` names their column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default and demo chunk sizes, tokens kept for a part's header, characters by which a cut is trimmed.
CHUNK_TOKENS, DEMO_TOKENS, HEADER_TOKENS, TRIM = 8192, 4096, 50, 100
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def estimate(text: str) -> int:
    """The default counter; pass another, such as a BPE encoder's, where exact counts are wanted."""
    return -(-len(text) // 4)


class NextFit:
    """Chunk numbers of token counts in order: one that is too large stands alone, another starts a chunk if it does not fit."""

    def __init__(self, limit: int):
        self.limit, self.chunk, self.used, self.open = limit, -1, 0, False

    def put(self, tokens: int) -> int:
        if tokens > self.limit:
            self.chunk, self.open = self.chunk + 1, False
        elif not self.open or self.used + tokens > self.limit:
            self.chunk, self.used, self.open = self.chunk + 1, tokens, True
        else:
            self.used += tokens
        return self.chunk


def pack(parts: DataFrame, limit: int = CHUNK_TOKENS, by: str | None = None) -> DataFrame:
    """parts (part_ord, tokens, and `by`) with chunk_id, from 0 in each export."""
    keys = [by] if by else []
    narrow = parts.select(*keys, "part_ord", "tokens")
    sorted_parts = (narrow.repartition(by) if by else narrow.repartition(1)).sortWithinPartitions(*keys, "part_ord")
    shape = [*[f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in keys], f"part_ord {parts.schema['part_ord'].dataType.simpleString()}", f"tokens {parts.schema['tokens'].dataType.simpleString()}", "chunk_id long"]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), NextFit(limit)
        for f in frames:
            out = []
            for key, tokens in zip(f[by] if by else [None] * len(f), f["tokens"], strict=True):
                if by and key != now:
                    now, state = key, NextFit(limit)
                out.append(state.put(int(tokens)))
            yield f.assign(chunk_id=pd.Series(out, index=f.index, dtype="int64"))

    return sorted_parts.mapInPandas(fold, ", ".join(shape))


def merge_parts(parts: list[str], limit: int, separator: str, count: Callable[[str], int] = estimate) -> list[str]:
    """Neighbouring parts joined while their counts add up to the limit at most."""
    groups: list[list[str]] = []
    state, last = NextFit(limit), -1
    for p in parts:
        at = state.put(count(p))
        if at != last:
            groups.append([])
        groups[-1].append(p)
        last = at
    return [separator.join(g) for g in groups]


def split_text(text: str, limit: int, count: Callable[[str], int] = estimate) -> list[str]:
    """By paragraphs if all of them fit, else by sentences if all fit, else cut; a cut goes on where the last one ended."""
    if count(text) <= limit:
        return [text]
    for pieces, separator in ((text.split("\n\n"), "\n\n"), (SENTENCE.split(text), " ")):
        if len(pieces) > 1:
            merged = merge_parts(pieces, limit, separator, count)
            if all(count(m) <= limit for m in merged):
                return merged
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + limit * 4)
        while count(text[at:end]) > limit and end - at > TRIM:
            end -= TRIM
        out.append(text[at:end])
        at = end
    return out


def split_messages(contents: list[str], limit: int, count: Callable[[str], int] = estimate) -> list[list[tuple[int, int, str]]]:
    """Parts of a conversation too long for the limit, as lists of (message, its part or 0, text)."""
    if limit <= HEADER_TOKENS:
        raise ValueError(f"the limit has to be above {HEADER_TOKENS}")
    budget = limit - HEADER_TOKENS
    out: list[list[tuple[int, int, str]]] = []
    state, last = NextFit(budget), -1
    for k, text in enumerate(contents):
        n = count(text)
        at = state.put(n)
        if n > budget:
            out += [[(k, i + 1, t)] for i, t in enumerate(split_text(text, budget, count))]
        elif at != last:
            out.append([(k, 0, text)])
        else:
            out[-1].append((k, 0, text))
        last = at
    return out


PREPARED = "conv_ord long, id string, title string, create_time double, part_num int, msg_ord int, message_id string, role string, content string, timestamp double, is_hidden boolean"


def prepare(conversations: DataFrame, messages: DataFrame, rendered: DataFrame, limit: int = CHUNK_TOKENS, count: Callable[[str], int] = estimate, tokens: F.Column | None = None) -> DataFrame:
    """Messages of all conversations, of those above the limit in parts: part_num from 1 (0: whole), title `<title> (part N)`, id kept.

    Conversations are split in parallel, each by itself; those that fit never leave the JVM.
    """
    size = tokens if tokens is not None else F.ceil(F.length("rendered") / 4)
    sized = rendered.select("conv_ord", (size > limit).alias("_long"))
    head = conversations.select(F.col("conv_ord").alias("_o"), "id", "title", "create_time")
    flat = messages.withColumnRenamed("id", "message_id").join(sized, "conv_ord").join(head, F.col("conv_ord") == F.col("_o"))
    columns = ["conv_ord", "id", "title", "create_time", "msg_ord", "message_id", "role", "content", "timestamp", "is_hidden"]
    whole = flat.filter("NOT _long").select(*columns[:4], F.lit(0).alias("part_num"), *columns[4:])

    def split(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("msg_ord", kind="stable").reset_index(drop=True)
        rows = []
        for number, part in enumerate(split_messages(f["content"].fillna("").tolist(), limit, count), 1):
            for k, i, text in part:
                r = f.iloc[k].to_dict()
                rows.append(r | {"title": f"{r['title']} (part {number})", "part_num": number, "message_id": f"{r['message_id']}_part{i}" if i else r["message_id"], "content": text})
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PREPARED.split(", ")])

    parts = flat.filter("_long").select(*columns).groupBy("conv_ord").applyInPandas(split, PREPARED)
    return whole.unionByName(parts)
