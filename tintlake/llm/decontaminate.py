"""Benchmark decontamination by pigeonhole edit matching.

An item of L characters may occur with up to ``rate * L`` edits. It is cut into one piece more than that: of any
occurrence within the budget, one piece at least is unharmed. All pieces of all items form one multi-pattern
automaton; each exact hit gives a place, and the item is verified there by Myers' bit-parallel edit distance (the
item's length in bits, one step a character). Texts and items are compared in lower case with white space collapsed.

The automaton travels to the tasks; it is built from at most ``BLOCK_CHARS`` characters of items. A larger benchmark
is matched block by block.

Nulls: null texts and items count as empty; empty items match nothing. Null ids are kept. Repeated document rows are
matched each, repeated item rows once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintlake.llm.common import small_batches, unused, worker_memory

RATE = 0.06
BLOCK_CHARS = 8_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item cut into ``budget + 1`` parts of nearly equal length, with their places."""
    n = budget + 1
    edges = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def myers(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """Least edit distance of the item to any part of the text, and the end of the first such part; None if above."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = budget + 1, -1
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (~(xh | up) & full)
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # a match may begin anywhere: no cost before it
        mh = (mh << 1) & full
        up = mh | (~(xv | ph) & full)
        down = ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= budget else None


class Matcher:
    """Items as an automaton of pieces."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, int(rate * len(t))) for i, t in items if t]
        self.automaton = ahocorasick.Automaton()
        for k, (_, text, budget) in enumerate(self.items):
            for at, piece in pieces(text, budget):
                if piece in self.automaton:
                    self.automaton.get(piece).append((k, at))
                else:
                    self.automaton.add_word(piece, [(k, at)])
        for piece in self.automaton:
            self.automaton.get(piece).append(len(piece))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, distance, start, end) of every place in a normalised text that matches an item."""
        if not self.items:
            return []
        done: dict[int, list[tuple[int, int]]] = {}  # item -> places looked at, from left to right
        out = []
        for last, places in self.automaton.iter(text):
            begin = last + 1 - places[-1]
            for k, at in places[:-1]:
                item_id, item, budget = self.items[k]
                start = begin - at
                seen = done.setdefault(k, [])
                if any(a <= start <= b for a, b in seen[-4:]):
                    continue
                if start >= 0 and text.startswith(item, start):
                    hit = (0, start, start + len(item))
                else:
                    lo = max(0, start - budget)
                    region = text[lo : start + len(item) + budget]
                    got = myers(item, region, budget)
                    if not got:
                        # The same piece with another shift is another place; this one needs no second look.
                        seen.append((start, start))
                        continue
                    back = myers(item[::-1], region[: got[1]][::-1], budget)
                    hit = (got[0], lo + got[1] - back[1], lo + got[1])
                seen.append((hit[1] - budget, hit[1] + max(budget, 1)))
                out.append((item_id, *hit))
        return out


FOUND = "array<struct<item_id: long, distance: int, start: int, end: int>>"


def _finder(items, rate: float, token: str):
    @F.pandas_udf(FOUND)
    def find(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory = worker_memory("benchmark")
        if memory.get("matcher", (None,))[0] != token:  # built once a worker
            memory["matcher"] = (token, Matcher(items.value, rate))
        matcher = memory["matcher"][1]
        for texts in columns:
            out = []
            for text in texts.fillna(""):
                out.append([{"item_id": i, "distance": d, "start": a, "end": b} for i, d, a, b in matcher.find(normal(text))])
            yield pd.Series(out)

    return find


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """Distinct normalised items in blocks of about ``BLOCK_CHARS`` characters."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).distinct()
    chars = rows.agg(F.sum(F.length("_text"))).first()[0] or 0
    blocks = -(-int(chars) // BLOCK_CHARS) or 1
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield sorted({(r["_id"], normal(r["_text"])) for r in part.collect()}, key=lambda x: (x[0] is None, x))


def with_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, name: str = "matches") -> DataFrame:
    """Add an array of (item_id, distance, start, end) for each document as the last column, its name followed by an
    underscore if the documents have that name; places count in the normalised text."""
    if not 0 <= rate < 1:
        raise ValueError("rate must be at least 0 and below 1")
    small_batches(docs.sparkSession)
    found = None
    for items in item_blocks(benchmark, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(items)
        part = _finder(sent, rate, uuid.uuid4().hex)(F.col(f"`{text_col}`"))
        found = part if found is None else F.concat(found, part)
    return docs.withColumn(unused(docs, name), found)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per document row and item found in it: id, item_id, distance (least), places, start, end (of the best)."""
    found = with_matches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), benchmark, "_text", rate=rate)
    first = F.expr("array_sort(array_distinct(transform(matches, m -> m.item_id)))")
    item = found.select("_id", "matches", F.explode(first).alias("item_id"))
    mine = F.filter("matches", lambda m: m["item_id"].eqNullSafe(F.col("item_id")))
    best = item.select("_id", "item_id", F.size(mine).alias("places"), F.array_min(F.transform(mine, lambda m: F.struct(m["distance"].alias("distance"), m["start"].alias("start"), m["end"].alias("end")))).alias("best"))
    return best.select(F.col("_id").alias(id_col), "item_id", "best.distance", "places", "best.start", "best.end")
