"""Periodic runs of words: an online diagonal DP that keeps few lags active.

Match lengths grow along diagonals: a word that equals the one ``p`` words before adds one to lag ``p``, any other word
ends that diagonal, and a diagonal that ends with sufficient length is a run. A word can have very many earlier
occurrences, so lags are kept sparse, exactly:

* A run of period ``p`` is at least four periods long: three periods of consecutive words each have an earlier
  occurrence at most ``p`` back. Words outside such stretches activate no lag.
* Lags are worked in classes ``lo..hi`` with ``hi`` about ``1.5 lo``. Inside a stretch, a word activates the lag to the
  latest earlier occurrence of the ``3 lo`` words that begin there. In a run of smallest period ``p`` of the class this
  is ``p`` itself: a nearer one would be a smaller period of those ``3 lo >= 2 p`` words and so of the whole run; and as
  ``3 lo <= 3 p``, every run of sufficient length holds such a word twice. So a word has at most one active lag a class.

The lags of a block of texts are increments of equal consecutive lags, so they are added up in numpy; work is
n log n for any text. Words are compared by 64-bit hashes.

Nulls: a null text has no words. Empty texts have none. Repeated rows are worked each; all columns of the input are
kept as they are; the result is the last column, its name followed by an underscore if the input has that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintlake.llm.common import rolling, small_batches, span_hash, text_blocks, unused, word_bounds, word_hashes

LEAST_WORDS, LEAST_PERIODS = 6, 4

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # first word, length, period


def lag_classes(longest: int) -> Iterator[tuple[int, int, int, int]]:
    """(lo, hi, words compared, least match length) of the classes of lags that a text of ``longest`` words can have."""
    lo = 1
    while LEAST_PERIODS * lo <= longest:
        hi = 3 * lo // 2
        yield lo, hi, 3 * lo, max(LEAST_WORDS - lo, (LEAST_PERIODS - 1) * lo)
        lo = hi + 1


def _lag_back(keys: np.ndarray) -> np.ndarray:
    """How far back the latest earlier occurrence of each key lies; 0 if there is none."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    back = np.zeros(len(keys), dtype=np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    return back


def _stretches(inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True that are at least ``least`` long."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def runs_of(words: np.ndarray, first: np.ndarray) -> Runs:
    """Runs of a block of word hashes whose rows begin at ``first`` (with the end), ordered by start, then period."""
    found: list[Runs] = []
    sizes = np.diff(first)
    if len(words) < LEAST_WORDS:
        return (np.zeros(0, np.int64),) * 3
    row = np.repeat(np.arange(len(sizes)), sizes)
    back = _lag_back(words)
    here = np.arange(len(words))
    back[row[here - back] != row] = 0  # the occurrence is in another row
    prefix = None
    for lo, hi, width, least in lag_classes(int(sizes.max())):
        for a, b in zip(*_stretches((back > 0) & (back <= hi), max(least, width))):
            prefix = rolling(words) if prefix is None else prefix
            low = max(int(first[row[a]]), int(a) - hi)
            at = np.arange(low, b - width + 1)
            lag = _lag_back(span_hash(prefix, at, at + width))[a - low :]
            lag[(lag < lo) | (lag > hi)] = 0
            # equal consecutive lags are one diagonal: its match length is their number and the rest of the last words
            edge = np.flatnonzero(np.diff(np.concatenate([[0], lag, [0]])))
            period = np.concatenate([[0], lag, [0]])[edge[:-1] + 1]
            start, end = a + edge[:-1] - period, a + edge[1:] - 1 + width
            whole = (period > 0) & (end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period))
            found.append((start[whole], (end - start)[whole], period[whole]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _block(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Runs, list[bytes]]:
    """Words of each row, runs of each row, the runs with starts counted in their row, and the collapsed texts."""
    starts, ends, first = word_bounds(data, offsets)
    start, length, period = runs_of(word_hashes(data, starts, ends), first)
    of = np.searchsorted(first, start, side="right") - 1
    begin, end = np.searchsorted(of, np.arange(len(first) - 1), side="left"), np.searchsorted(of, np.arange(len(first) - 1), side="right")
    change = np.zeros(len(starts) + 1, dtype=np.int32)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change)[:-1] == 0
    raw, texts = data.tobytes(), []
    for k in range(len(first) - 1):
        words = raw[offsets[k] : offsets[k + 1]].split()  # at the same six bytes
        texts.append(b" ".join(compress(words, kept[first[k] : first[k + 1]]) if end[k] > begin[k] else words))
    return np.diff(first), end - begin, (start - first[of], length, period), texts


RESULT = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


def _found(texts: pa.Array) -> pa.Array:
    counts, sizes, runs, kept = [], [], [], []
    for _, _, data, offsets in text_blocks(pa.RecordBatch.from_arrays([texts], ["_text"])):
        n, size, spans, collapsed = _block(data, offsets)
        counts.append(n)
        sizes.append(size)
        runs.append(spans)
        kept += collapsed
    joined = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    spans = pa.StructArray.from_arrays([pa.array(joined([r[k] for r in runs])) for k in range(3)], ["start", "length", "period"])
    offsets = np.concatenate([[0], np.cumsum(joined(sizes))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), spans)
    return pa.StructArray.from_arrays([pa.array(joined(counts)), lists, pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])


def with_runs(docs: DataFrame, text_col: str = "text", name: str = "periodic") -> DataFrame:
    """Add a struct: n_words; runs (start word from 0, length, smallest period) by start, then period; and ``collapsed``,
    the words outside every run or in a run's first period, joined by one space."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(RESULT)
    def search(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            yield _found(texts)

    return docs.withColumn(unused(docs, name), search(F.col(f"`{text_col}`")))
