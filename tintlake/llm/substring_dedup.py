"""Removal of word passages that occur more than once (substring dedup).

Matching statistics come from suffix automata over shards of the corpus's own repeated material. An automaton of
the whole corpus cannot be broadcast (it grows with the corpus), so the shards stay where a shuffle puts them and
the passages travel to them:

1. Winnowing: in every window of ``window`` words the leftmost gram (``gram`` words) of smallest hash is its mark.
   Equal windows have equal marks, so only passages whose mark occurs twice can hold a repeat. The windows of one
   mark occurrence are consecutive; their words form a segment, and every window lies in exactly one segment.
2. Marks are counted. Where all segments of a repeated mark are equal, all their windows repeat.
3. The distinct segments of the other repeated marks meet on the mark. A shard of them becomes one suffix
   automaton with occurrence counts; each segment streams through it and windows met at least twice are kept.
4. Marks with very many distinct segments do not fit one shard: their windows are hashed and counted by Spark.
5. Kept windows become maximal spans, joined back to the texts.

Nulls: a null text has no words; a null id is an ordinary id. Rows repeated in full count as two texts (both lose
every window). Texts shorter than a window never change. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintlake.llm.common import ids_and_texts, mix, rolling, row_key, signed, span_hash, stored, text_blocks, word_bounds, word_hashes
from tintlake.runtime import SALTS

WINDOW = 35
GRAM = 8
# Distinct segments of one mark that may meet in one automaton; above, windows are counted by hash instead.
SHARD_SEGMENTS = 3000
# Words of one automaton.
SHARD_WORDS = 40_000
# A mark (or a pair of mark and segment) is common if it has at least this part of all rows, so at most as many are common,
COMMON_MARKS = 10_000
# and at least so many rows: fewer are no burden to a task.
COMMON_ROWS = 1000


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest of each ``width`` consecutive values."""
    at = np.arange(len(values))
    done = 1
    while done < width:
        step = min(done, width - done)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        done += step
    return at


def _marks(window: int, gram: int):
    def run(batches):
        for batch in batches:
            k1, k2 = batch.column("_k1"), batch.column("_k2")
            for row, n, data, offsets in text_blocks(batch):
                starts, ends, first = word_bounds(data, offsets)
                if len(starts) < window:
                    continue
                words = word_hashes(data, starts, ends)
                prefix = rolling(words)
                g = np.arange(len(words) - gram + 1)
                grams = span_hash(prefix, g, g + gram)
                low = leftmost_minima(grams, window - gram + 1)  # of the window that starts at each word
                doc = np.searchsorted(first, np.arange(len(low)), side="right") - 1
                keep = np.arange(len(low)) + window <= first[doc + 1]
                at, low, doc = np.flatnonzero(keep), low[keep], doc[keep]
                if not len(at):
                    continue
                new = np.ones(len(at), dtype=bool)
                new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                begin = np.flatnonzero(new)
                until = np.append(begin[1:], len(at)) - 1
                lo, hi, mark, doc = at[begin], at[until] + window, low[begin], doc[begin]
                seg = span_hash(prefix, lo, hi) ^ mix((mark - lo).astype(np.uint64) + np.uint64(1))
                take = pa.array(doc + row)
                yield pa.record_batch(
                    [k1.take(take), k2.take(take), pa.array((lo - first[doc]).astype(np.int32)), pa.array((hi - first[doc]).astype(np.int32)), pa.array(signed(grams[mark])), pa.array(signed(seg))],
                    names=["_k1", "_k2", "lo", "hi", "mark", "seg"],
                )

    return run


def _contents(frames):
    """Text of each distinct segment of a row that has to be compared."""
    for df in frames:
        out = []
        for text, marks in zip(df["_text"], df["marks"]):
            words = text.encode().split()
            for m in marks:
                out.append((m["mark"], m["seg"], m["n"], b" ".join(words[m["lo"] : m["hi"]])))
        yield pd.DataFrame(out, columns=["mark", "seg", "n", "words"])


class SuffixAutomaton:
    """Suffix automaton of a sequence with weighted ends; ``count`` of a state is the weight of its occurrences."""

    def __init__(self, symbols: list, weights: list[int]):
        nexts, link, length, count = [{}], [-1], [0], [0]
        last = 0
        for symbol, weight in zip(symbols, weights):
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(weight)
            p = last
            while p != -1 and symbol not in nexts[p]:
                nexts[p][symbol] = cur
                p = link[p]
            if p != -1:
                q = nexts[p][symbol]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(nexts[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    count.append(0)
                    while p != -1 and nexts[p].get(symbol) == q:
                        nexts[p][symbol] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        for state in sorted(range(1, len(nexts)), key=length.__getitem__, reverse=True):
            if link[state] > 0:
                count[link[state]] += count[state]
        self.nexts, self.link, self.length, self.count = nexts, link, length, count

    def repeated(self, symbols: list, window: int) -> list[int]:
        """Starts of the windows that occur with a weight of at least two."""
        nexts, link, length, count = self.nexts, self.link, self.length, self.count
        state, matched, out = 0, 0, []
        for end, symbol in enumerate(symbols, 1):
            while state and symbol not in nexts[state]:
                state = link[state]
                matched = length[state]
            if symbol in nexts[state]:
                state, matched = nexts[state][symbol], matched + 1
            while length[link[state]] >= window if state else False:
                state = link[state]
                matched = length[state]
            if matched >= window and count[state] >= 2:
                out.append(end - window)
        return out


def to_ranges(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Word ranges covered by windows that begin at the given ascending starts."""
    out: list[list[int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1][1] = s + window
        else:
            out.append([s, s + window])
    return [tuple(x) for x in out]


def _by_automaton(window: int):
    """Segments sorted by mark come in; a shard ends at the first change of mark beyond ``SHARD_WORDS``."""

    def shard(rows):
        symbols, weights = [], []
        for i, (_, _, n, words) in enumerate(rows):
            symbols += words
            weights += [n] * len(words)
            symbols.append(i)  # ends every match: no other segment holds it
            weights.append(1)
        automaton = SuffixAutomaton(symbols, weights)
        out = []
        for mark, seg, _, words in rows:
            for a, b in to_ranges(automaton.repeated(words, window), window):
                out.append((mark, seg, a, b))
        return pd.DataFrame(out, columns=["mark", "seg", "a", "b"])

    def run(frames):
        rows, size, last = [], 0, None
        for df in frames:
            for mark, seg, n, words in zip(df["mark"], df["seg"], df["n"], df["words"]):
                if size > SHARD_WORDS and mark != last:
                    yield shard(rows)
                    rows, size = [], 0
                words = bytes(words).split()
                rows.append((mark, seg, n, words))
                size += len(words)
                last = mark
        if rows:
            yield shard(rows)

    return run


def _window_hashes(window: int):
    def run(frames):
        for df in frames:
            out = []
            for mark, seg, n, words in zip(df["mark"], df["seg"], df["n"], df["words"]):
                words = bytes(words).split()
                for a in range(len(words) - window + 1):
                    h = hashlib.blake2b(b" ".join(words[a : a + window]), digest_size=16).digest()
                    out.append((mark, seg, a, n, h))
            yield pd.DataFrame(out, columns=["mark", "seg", "a", "n", "h"])

    return run


def _common(counts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """The common ones of ``keys``, counted by column n."""
    return counts.filter((F.col("n") >= COMMON_ROWS) & (F.col("n") * COMMON_MARKS >= total)).select(*keys)


def _per_salt(facts: DataFrame, common: DataFrame) -> DataFrame:
    """Facts with a column _salt: those of common keys once for each of ``SALTS``, all others once."""
    known = F.broadcast(common.withColumn("_common", F.lit(True)))
    salts = F.when(F.col("_common"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return facts.join(known, common.columns, "left").withColumn("_salt", F.explode(salts)).drop("_common")


def _spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], common: DataFrame, place) -> DataFrame:
    """Inner join on ``keys``, of which some are common: their rows are cut into ``SALTS`` parts by ``place``, and
    only their facts are repeated. ``common`` (columns of the keys, at most ``COMMON_MARKS`` rows) is broadcast."""
    known = F.broadcast(common.withColumn("_common", F.lit(True)))
    salt = F.when(F.col("_common"), F.pmod(place, F.lit(SALTS))).otherwise(0).cast("int")
    return rows.join(known, common.columns, "left").withColumn("_salt", salt).drop("_common").join(_per_salt(facts, common), [*keys, "_salt"]).drop("_salt")


def repeated_spans(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(_k1, _k2, lo, hi): word ranges, relative to a row's text, covered by windows that occur elsewhere too.

    ``docs`` has _id, _text, _k1, _k2."""
    marks = stored(docs.mapInArrow(_marks(window, gram), "_k1 long, _k2 long, lo int, hi int, mark long, seg long"), "marks")
    # Two segments of one row of a pair of rows repeated in full share keys; count() sees both.
    seen = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), (F.min("seg") == F.max("seg")).alias("same")).filter("n >= 2")
    seen = stored(seen, "seen")
    total = marks.count()
    common = _common(seen, ["mark"], total)
    place = F.xxhash64("_k1", "_k2", "lo")
    shared = stored(_spread_join(marks, seen.drop("n"), ["mark"], common, place), "shared")
    plain = shared.filter("same").select("_k1", "_k2", "lo", "hi")
    compared = shared.filter("not same").drop("same")
    # the content of a segment is read at one of its places
    first = F.min(F.struct("_k1", "_k2", "lo", "hi")).alias("at")
    segments = compared.groupBy("mark", "seg").agg(F.count(F.lit(1)).alias("n"), first)
    wanted = segments.groupBy("at._k1", "at._k2").agg(F.collect_list(F.struct("at.lo", "at.hi", "mark", "seg", "n")).alias("marks"))
    texts = docs.select("_k1", "_k2", "_text").join(wanted, ["_k1", "_k2"])
    contents = texts.select("_text", "marks").mapInPandas(_contents, "mark long, seg long, n long, words binary")
    # rows repeated in full share their keys, so each of them brings the content
    segments = contents.groupBy("mark", "seg").agg(F.first("n").alias("n"), F.first("words").alias("words"))
    segments = stored(segments, "segments")
    sizes = segments.groupBy("mark").agg((F.count(F.lit(1)) > SHARD_SEGMENTS).alias("large"))
    sized = _spread_join(segments, sizes, ["mark"], common, F.col("seg"))
    found = (
        sized.filter("not large")
        .select("mark", "seg", "n", "words")
        .repartition(_width(docs), "mark")
        .sortWithinPartitions("mark", "seg")
        .mapInPandas(_by_automaton(window), "mark long, seg long, a int, b int")
    )
    windows = sized.filter("large").select("mark", "seg", "n", "words").mapInPandas(_window_hashes(window), "mark long, seg long, a int, n long, h binary")
    twice = windows.groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 2").select("h")
    counted = windows.join(twice, "h").select("mark", "seg", "a", (F.col("a") + window).alias("b"))
    ranges = found.unionByName(counted)
    # a common mark has many segments and each its ranges: only those of a common segment are repeated
    exact = _spread_join(compared, ranges, ["mark", "seg"], _common(segments, ["mark", "seg"], total), place).select("_k1", "_k2", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi"))
    return plain.unionByName(exact)


def _width(df: DataFrame) -> int:
    """An explicit width a third over the session's, so that compute-heavy partitions are not merged for small data."""
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4 // 3)


def _kept(frames):
    for df in frames:
        out = []
        for i, text, spans in zip(df["_id"], df["_text"], df["spans"]):
            words = text.encode().split()
            keep = words
            if spans is not None and len(spans):
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for s in spans:
                    gone[s["lo"]] += 1
                    gone[s["hi"]] -= 1
                keep = [w for w, g in zip(words, np.cumsum(gone)) if not g]
            out.append((i, len(words), len(words) - len(keep), b" ".join(keep)))
        yield pd.DataFrame({"_id": pd.Series([x[0] for x in out], dtype=df["_id"].dtype), "n_words": [x[1] for x in out], "n_removed": [x[2] for x in out], "kept": [x[3] for x in out]})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (UTF-8 bytes of the kept words joined by one space).

    Words are runs without ASCII white space. Every word is removed that a window of ``window`` words covers whose
    words also start at another place of the corpus. Judged on the input, so both copies go.
    """
    if not 1 <= gram < window:
        raise ValueError("gram must be at least 1 and shorter than window")
    rows = ids_and_texts(docs, id_col, text_col).select("_id", "_text", *row_key())
    kind = dict(rows.dtypes)["_id"]
    spans = repeated_spans(rows, window, gram).groupBy("_k1", "_k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    out = rows.join(spans, ["_k1", "_k2"], "left").select(F.col("_id").cast("string").alias("_id"), "_text", "spans")
    kept = out.mapInPandas(_kept, "_id string, n_words long, n_removed long, kept binary")
    return kept.select(F.col("_id").cast(kind).alias(id_col), "n_words", "n_removed", "kept")
