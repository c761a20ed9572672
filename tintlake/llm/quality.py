"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees are grown on a bounded sample of labelled documents; every path from a root to a node is a rule, a
conjunction of comparisons of statistics. A lasso logistic regression over the rules keeps few of them, and the kept
rules become one Spark column expression. Statistics are taken from whole texts; neither ids nor labels, language or
source enter them.

Nulls: a null text counts as empty; an empty text has all statistics 0 and is scored like any other. Labels that are
null, or of unknown documents, are left out. Without labels of both kinds the score is the share of label 1, or 1
without labels at all. Repeated rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tintlake.llm.common import mix, small_batches, text_blocks, unused, whole_row, word_bounds, word_hashes

# Most labelled documents that a model is fitted on: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
TREES = 30
DEPTH = 3
THRESHOLD = 0.7

STATS = [
    "chars", "words", "word_length", "upper", "digit", "symbol", "bar", "mark", "other", "distinct", "echo", "odd_end",
    "capital_words", "long_words", "line_length", "lines", "sentence", "run",
]


def _lut(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_UPPER = _lut(bytes(range(65, 91)))
_LOWER = _lut(bytes(range(97, 123)))
_DIGIT = _lut(b"0123456789")
_SYMBOL = _lut(b"#$%&*+/<=>@\\^_`{|}~")
_BAR = _lut(b"|")
_MARK = _lut(b"!?")
_STOP = _lut(b".!?")
_LINE = _lut(b"\n")
_MORE = _lut(bytes(range(128, 192)))  # continuation bytes are not characters


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1

    def total(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=sums[1:])
        return (sums[edges[1:]] - sums[edges[:-1]]).astype(float)

    starts, ends, first = word_bounds(data, offsets)
    size = np.maximum(offsets[1:] - offsets[:-1], 1).astype(float)
    chars = (offsets[1:] - offsets[:-1]) - total(_MORE[data], offsets)
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    length = (ends - starts).astype(np.int64)
    hashes = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(rows), np.diff(first))
    key = np.sort((row.astype(np.uint64) << np.uint64(48)) | (mix(hashes) >> np.uint64(16)))
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> np.uint64(48)).astype(np.int64), minlength=rows)
    echo = np.zeros(len(hashes), dtype=bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    tail, head = data[ends - 1] if len(ends) else data[:0], data[starts] if len(starts) else data[:0]
    second = data[np.minimum(starts + 1, len(data) - 1)] if len(starts) else data[:0]
    breaks = np.flatnonzero(~echo)
    runs = np.diff(np.append(breaks, len(echo)))
    longest = np.zeros(rows)
    np.maximum.at(longest, row[breaks], runs)
    lines = total(_LINE[data], offsets) + 1
    return np.column_stack([
        np.log1p(chars), np.log1p(words), total(length, first) / some, total(_UPPER[data], offsets) / size, total(_DIGIT[data], offsets) / size,
        total(_SYMBOL[data], offsets) / size, total(_BAR[data], offsets) / some, total(_MARK[data], offsets) / some, total(data >= 128, offsets) / size,
        distinct / np.maximum(np.sqrt(words), 1), total(echo, first) / some, total(_SYMBOL[tail] | _MARK[tail], first) / some,
        total(_UPPER[head] & _UPPER[second] & (length > 1), first) / some, total(length > 12, first) / some, np.log1p(chars / lines), lines / some,
        total(_STOP[tail], first) / some, longest / some,
    ])


def _with_statistics(batches):
    for batch in batches:
        parts = [_statistics(data, offsets) for _, _, data, offsets in text_blocks(batch)]
        if not parts:
            continue
        stats = np.concatenate(parts)
        keep = batch.schema.get_field_index("_row")
        yield pa.record_batch([batch.column(keep), *(pa.array(np.ascontiguousarray(stats[:, i])) for i in range(len(STATS)))], names=["_row", *STATS])


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows as a struct ``_row``, and the statistics of their text."""
    small_batches(docs.sparkSession)
    rows = docs.select(whole_row(docs), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    fields = StructType([rows.schema["_row"], *[StructField(s, DoubleType()) for s in STATS]])
    return rows.mapInArrow(_with_statistics, fields)


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above, threshold), ...


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            hit = None
            for name, above, cut in rule:
                test = F.col(name) > F.lit(cut) if above else F.col(name) <= F.lit(cut)
                hit = test if hit is None else hit & test
            z = z + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _grow(binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, bins: int) -> tuple[list, np.ndarray]:
    """One tree: its nodes as paths of (feature, above, bin), and the step of each row."""
    step = np.zeros(len(gradient))
    paths: list[tuple] = []
    open_nodes = [((), np.arange(len(gradient)))]
    for depth in range(DEPTH + 1):
        following = []
        for path, rows in open_nodes:
            g, h = gradient[rows], hessian[rows]
            step[rows] = -g.sum() / (h.sum() + 1)
            if depth == DEPTH or len(rows) < 40:
                continue
            best = (1e-6, None)
            whole = g.sum() ** 2 / (h.sum() + 1)
            for f in range(binned.shape[1]):
                b = binned[rows, f]
                gl, hl = np.cumsum(np.bincount(b, g, bins))[:-1], np.cumsum(np.bincount(b, h, bins))[:-1]
                n = np.cumsum(np.bincount(b, minlength=bins))[:-1]
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                gain[(n < 15) | (len(rows) - n < 15)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, k))
            if best[1] is None:
                continue
            f, k = best[1]
            left = binned[rows, f] <= k
            for above, part in ((False, rows[left]), (True, rows[~left])):
                paths.append((*path, (f, above, k)))
                following.append((paths[-1], part))
        open_nodes = following
    return paths, step


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 250) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal steps; the intercept is free."""
    n, k = x.shape
    w, b = np.zeros(k, dtype=np.float32), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, vb, t = w.copy(), b, 1.0
    probe = np.ones(k, dtype=np.float32) / np.sqrt(max(k, 1))
    for _ in range(12):
        probe = x.T @ (x @ probe)
        probe /= np.linalg.norm(probe) + 1e-9
    rate = 1.0 / (0.25 * (np.linalg.norm(x @ probe) ** 2 / n + 1) * 1.05)
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(x @ v + vb, -30, 30))) - y
        nw = v - rate * (x.T @ r / n).astype(np.float32)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = vb - rate * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return float(b), w


def fit_rules(stats: np.ndarray, label: np.ndarray, names: list[str] = STATS) -> RuleModel:
    """Rules and weights from the statistics of labelled rows."""
    if not len(label):
        return RuleModel(40.0, [])
    if label.min() == label.max():
        return RuleModel(40.0 if label[0] else -40.0, [])
    cuts = [np.unique(np.quantile(stats[:, f], np.linspace(0, 1, 34)[1:-1])) for f in range(stats.shape[1])]
    binned = np.column_stack([np.searchsorted(c, stats[:, f], side="left") for f, c in enumerate(cuts)])
    bins = max(len(c) for c in cuts) + 1
    z = np.full(len(label), np.log(label.mean() / (1 - label.mean())))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        paths, step = _grow(binned, p - label, p * (1 - p), bins)
        z += 0.3 * step
        for path in paths:
            bound: dict[tuple[int, bool], int] = {}
            for f, above, k in path:  # the tightest comparison of a kind
                bound[f, above] = (max if above else min)(bound.get((f, above), k), k)
            rules[tuple((names[f], above, float(cuts[f][min(k, len(cuts[f]) - 1)])) for (f, above), k in sorted(bound.items()))] = None
    listed = list(rules)
    place = {n: i for i, n in enumerate(names)}
    x = np.ones((len(label), len(listed)), dtype=np.float32)
    for j, rule in enumerate(listed):
        for name, above, cut in rule:
            v = stats[:, place[name]]
            x[:, j] *= (v > cut) if above else (v <= cut)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    usable = scale > 0.02
    listed = [r for r, u in zip(listed, usable) if u]
    x = ((x[:, usable] - mean[usable]) / scale[usable]).astype(np.float32)
    mean, scale = mean[usable], scale[usable]
    inner = np.arange(len(label)) % 5 == 0
    losses = []
    for penalty in (0.01, 0.003, 0.001):
        b, w = _lasso(x[~inner], label[~inner], penalty, 120)
        q = np.clip(1 / (1 + np.exp(-(x[inner] @ w + b))), 1e-6, 1 - 1e-6)
        losses.append((-(label[inner] * np.log(q) + (1 - label[inner]) * np.log(1 - q)).mean(), penalty))
    b, w = _lasso(x, label, min(losses)[1])
    weights = w / scale
    kept = [(r, float(v)) for r, v in zip(listed, weights) if abs(v) > 1e-6]
    return RuleModel(float(b - (weights * mean).sum()), kept)


def held_out(id_col: str) -> Column:
    """The fold whose labels are never learned."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleModel:
    """Fit on at most ``SAMPLE_ROWS`` labelled documents outside the held-out fold; of rows with one id, the smallest text."""
    wanted = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    wanted = wanted.groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("_label"))
    wanted = wanted.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(wanted), "_id")
    texts = texts.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))  # at most SAMPLE_ROWS rows
    rows = with_statistics(texts, "_text").select("_row._id", "_row._label", *STATS).toPandas().sort_values(["_id", *STATS])
    return fit_rules(rows[STATS].to_numpy(), rows["_label"].to_numpy())


def score(docs: DataFrame, model: RuleModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of the documents and the score of each as the last column, its name followed by an underscore if the
    documents have that name."""
    return with_statistics(docs, text_col).select("_row.*", model.column().alias(unused(docs, name)))
