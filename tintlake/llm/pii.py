"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions for further spans.

The network is trained in numpy on the driver, from spans that the patterns label in a bounded sample of documents;
some are rewritten (a phone number without its plus, a card in other groups), so that it learns the shape and the
surroundings rather than the pattern. In tasks it reads overlapping windows. Every kind needs a digit or an at sign,
so windows without either are decoded only where a window beside them ends or begins inside a span; all others are,
whatever the text's length. The windows' Viterbi paths give candidate spans with the mean log-odds of their characters; over a whole text, the
non-overlapping set of greatest weight is kept (weighted interval scheduling), so windows that disagree are settled
together. A span longer than a stride may lie whole in no window: it is read from the windows' middle parts, which join.
Kept spans must pass their kind's check and must not touch a pattern's span, unless they are addresses that go on where
the pattern's ends.

Nulls: a null text counts as empty. Null ids are kept. Repeated rows are searched each. If the sample has no labelled
span, there is no network and only the patterns work.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintlake.llm.common import small_batches, unused

KINDS = ["email", "ip", "card", "phone"]
WINDOW, STRIDE = 64, 32
HIDDEN = 16
# Documents with a digit or an at sign that spans are labelled in: those with the smallest hash of their id, of each a
# part of its text.
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 20_000
EXAMPLES = 3000
STEPS = 500
BATCH = 64
# Windows decoded together.
DECODED = 512
# Mean log-odds that a span needs.
LEAST_WEIGHT = 1.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile("[0-9@]")
_DIGITS = re.compile("[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _card_ok(text: str) -> bool:
    digits = "".join(_DIGITS.findall(text))
    return 12 <= len(digits) <= 19 and luhn(digits)


def _ip_ok(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and kind.

    Each pattern is anchored where its leftmost match must begin (an address at the first character of the run before
    an at sign, numbers at the first digit of a run), which keeps long runs linear."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _ip_ok(m[0])]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and _card_ok(m[0])]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out)


# ---------------------------------------------------------------- characters and labels

_SIGNS = "@.-+_%() /:=\"'\n,#*|"
CLASSES = len(_SIGNS) + 7
_PAD = 0


def _class_table() -> np.ndarray:
    t = np.full(0x110000, 1, dtype=np.uint8)  # anything else
    t[0xC0:0x250] = 2  # letters with marks
    t[ord("0") : ord("9") + 1] = 3
    t[ord("a") : ord("z") + 1] = 4
    t[ord("A") : ord("Z") + 1] = 5
    for i, c in enumerate(_SIGNS):
        t[ord(c)] = 6 + i
    return t


def encode_chars(text: str, table: np.ndarray) -> np.ndarray:
    return table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def labels_of(length: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(length, dtype=np.int64)
    for start, kind, end in sorted(spans, key=lambda s: s[2] - s[0]):  # of overlapping spans the longer counts
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


def allowed_moves() -> np.ndarray:
    """Transitions that a labelling can have: an inside follows its begin or inside."""
    ok = np.ones((LABELS, LABELS), dtype=bool)
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


# ---------------------------------------------------------------- network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Tagger:
    """Weights: input per class (2, classes, 4H), recurrence (2, H, 4H), emission (2, H, labels), bias, transitions."""

    wx: np.ndarray
    u: np.ndarray
    v: np.ndarray
    bias: np.ndarray
    moves: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 1) -> Tagger:
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        wx = normal(2, CLASSES, 4 * HIDDEN, scale=0.2)
        wx[:, :, HIDDEN : 2 * HIDDEN] += 1.0  # forget gates open
        return cls(wx, normal(2, HIDDEN, 4 * HIDDEN, scale=0.2), normal(2, HIDDEN, LABELS, scale=0.2), np.zeros(LABELS, np.float32), np.zeros((LABELS, LABELS), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.wx, self.u, self.v, self.bias, self.moves]

    def emissions(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Label scores (T, B, labels) of windows (B, T); ``keep`` collects what training needs."""
        b, steps = x.shape
        both = np.stack([x.T, x.T[::-1]])  # (2, T, B)
        h = np.zeros((2, b, HIDDEN), np.float32)
        c = np.zeros_like(h)
        hs = np.empty((steps, 2, b, HIDDEN), np.float32)
        for t in range(steps):
            z = np.matmul(h, self.u)
            z[0] += self.wx[0][both[0, t]]
            z[1] += self.wx[1][both[1, t]]
            s, g = _sigmoid(z[..., : 3 * HIDDEN]), np.tanh(z[..., 3 * HIDDEN :])
            before = c
            c = s[..., HIDDEN : 2 * HIDDEN] * before + s[..., :HIDDEN] * g
            tc = np.tanh(c)
            if keep is not None:
                keep.append((h, before, s, g, tc))
            h = s[..., 2 * HIDDEN :] * tc
            hs[t] = h
        if keep is not None:
            keep.append((both, hs))
        return hs[:, 0] @ self.v[0] + hs[::-1, 1] @ self.v[1] + self.bias

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log-likelihood of labels (B, T) and its gradients."""
        keep: list = []
        e = self.emissions(x, keep).astype(np.float64)
        steps, b, _ = e.shape
        m = self.moves.astype(np.float64)

        def logsum(a, axis):
            top = a.max(axis=axis, keepdims=True)
            return (np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + logsum(alpha[t - 1][:, :, None] + m, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = logsum(m[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = logsum(alpha[-1], 1)
        gold = y.T
        rows = np.arange(b)
        score = sum(e[t, rows, gold[t]] for t in range(steps)) + sum(m[gold[t - 1], gold[t]] for t in range(1, steps))
        de = np.exp(alpha + beta - z[None, :, None])
        dm = np.zeros_like(m)
        for t in range(1, steps):
            dm += np.exp(alpha[t - 1][:, :, None] + m + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
            np.add.at(dm, (gold[t - 1], gold[t]), -1.0)
        for t in range(steps):
            de[t, rows, gold[t]] -= 1.0
        de = (de / b).astype(np.float32)
        both, hs = keep.pop()
        dv = np.stack([np.einsum("tbh,tbk->hk", hs[:, 0], de), np.einsum("tbh,tbk->hk", hs[::-1, 1], de)])
        dh_out = np.stack([de @ self.v[0].T, (de @ self.v[1].T)[::-1]], axis=1)  # in each direction's own order
        dwx, du = np.zeros_like(self.wx), np.zeros_like(self.u)
        dh, dc = np.zeros((2, b, HIDDEN), np.float32), np.zeros((2, b, HIDDEN), np.float32)
        ut = self.u.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            h, before, s, g, tc = keep[t]
            i, f, o = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :]
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=-1)
            du += np.matmul(h.transpose(0, 2, 1), dz)
            np.add.at(dwx[0], both[0, t], dz[0])
            np.add.at(dwx[1], both[1, t], dz[1])
            dh = np.matmul(dz, ut)
            dc = dc * f
        return float((z - score).mean()), [dwx, du, dv, de.sum(axis=(0, 1)), (dm / b).astype(np.float32)]

    def decode(self, x: np.ndarray, starts: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi labels (B, T) and how far each label's emission lies above the one for outside.

        ``starts``: windows that begin their text. Only the others can begin inside a span."""
        e = self.emissions(x)
        steps, b, _ = e.shape
        m = np.where(allowed_moves(), self.moves, np.float32(-1e4))
        best, back = e[0].copy(), np.empty((steps, b, LABELS), dtype=np.int8)
        best[np.broadcast_to(starts, b), 2::2] -= 1e4
        for t in range(1, steps):
            reach = best[:, :, None] + m
            back[t] = reach.argmax(axis=1)
            best = reach.max(axis=1) + e[t]
        path = np.empty((b, steps), dtype=np.int64)
        path[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = back[t][np.arange(b), path[:, t]]
        margin = np.take_along_axis(e, path.T[:, :, None], axis=2)[:, :, 0] - e[:, :, 0]
        return path, margin.T


def train_tagger(windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> Tagger:
    """Adam on shuffled batches."""
    net, r = Tagger.fresh(), np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1):
        rows = r.choice(len(windows), size=min(BATCH, len(windows)), replace=False)
        _, grads = net.gradients(windows[rows], labels[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * (0.1 ** (step / steps))
        for p, g, a, b in zip(net.parameters(), grads, first, second):
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


_LABELS_OF_HOSTS = ["mail", "office", "dept-research", "students", "eu", "north", "support"]
_FOREIGN = "äöüßéèñçøåłжиюя京都"


def _rewritten(text: str, kind: int, r: np.random.Generator) -> str:
    """Another way to write a labelled span."""
    digits = "".join(_DIGITS.findall(text))
    if kind == 3:
        d = digits[-10:]
        return [text, f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"][r.integers(4)]
    if kind == 2:
        sign = ["", " ", "-", "."][r.integers(4)]
        return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == 0 and "@" in text and r.integers(2):
        name, host = text.rsplit("@", 1)
        if r.integers(2):  # further parts
            host = ".".join([_LABELS_OF_HOSTS[int(i)] for i in r.integers(len(_LABELS_OF_HOSTS), size=int(r.integers(1, 7)))] + [host])
        for _ in range(int(r.integers(0, 4))):  # letters with marks, or of another script
            i = int(r.integers(len(host)))
            if host[i].isalpha():
                host = host[:i] + _FOREIGN[int(r.integers(len(_FOREIGN)))] + host[i + 1 :]
        return f"{name}@{host}"
    return text


def examples(texts: list[str], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Training windows and labels: around labelled spans, some rewritten, and around other digits and plain words."""
    r, table = np.random.default_rng(seed), _class_table()
    positive, other = [], []
    for text in texts:
        spans = base_spans(text)
        touched = [False] * len(spans)
        for k, (start, kind, end) in enumerate(spans):
            if any(s < end and start < e and j != k for j, (s, _, e) in enumerate(spans)):
                touched[k] = True
        for k, (start, kind, end) in enumerate(spans):
            if not touched[k] and end - start < WINDOW - 8:
                positive.append((text[max(0, start - WINDOW) : start], _rewritten(text[start:end], kind, r), text[end : end + WINDOW], kind))
        for m in _TRIGGER.finditer(text):
            if len(other) < 4 * EXAMPLES and not any(s - WINDOW < m.start() < e + WINDOW for s, _, e in spans):
                other.append(text[max(0, m.start() - WINDOW) : m.start() + WINDOW])
        if len(text) > WINDOW:
            at = int(r.integers(len(text) - WINDOW))
            if not any(s < at + WINDOW and at < e for s, _, e in spans):
                other.append(text[at : at + WINDOW])
    if not positive:
        return np.zeros((0, WINDOW), np.uint8), np.zeros((0, WINDOW), np.int64)
    xs, ys = [], []
    for n in range(EXAMPLES):
        if n % 3 < 2 or not other:
            left, span, right, kind = positive[int(r.integers(len(positive)))]
            span = _rewritten(span, kind, r)
            whole = left + span + right
            at = len(left)
            first, last = max(0, at + len(span) - WINDOW), at + 1
            if len(span) > STRIDE or n % 6 == 0:  # also windows that hold a part of the span
                first, last = max(0, at - WINDOW // 2), at + len(span) - 1
            lo = int(r.integers(min(first, last - 1), last))
            ys.append(_padded(labels_of(len(whole), [(at, kind, at + len(span))])[lo : lo + WINDOW], 0))
        else:
            whole = other[int(r.integers(len(other)))]
            lo = int(r.integers(max(1, len(whole) - WINDOW + 1)))
            ys.append(np.zeros(WINDOW, np.int64))
        xs.append(_padded(encode_chars(whole[lo : lo + WINDOW], table), _PAD))
    return np.array(xs), np.array(ys)


def _padded(a: np.ndarray, fill: int) -> np.ndarray:
    return np.concatenate([a, np.full(WINDOW - len(a), fill, dtype=a.dtype)])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger | None:
    """A tagger from the spans that the patterns label in the sample; None if they label none.

    The sample: ``SAMPLE_DOCS`` ids, of each one row (the greatest part) and of a text one part of ``SAMPLE_CHARS``
    characters that a hash of the id chooses."""
    piece = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(1)), F.greatest(F.ceil(F.length(F.col(text_col)) / SAMPLE_CHARS), F.lit(1))).cast("int")
    part = F.coalesce(F.col(text_col).substr(piece * SAMPLE_CHARS + 1, F.lit(SAMPLE_CHARS)), F.lit(""))
    texts = docs.select(F.col(id_col).alias("_id"), part.alias("_text"))
    wanted = docs.filter(F.col(text_col).rlike("[0-9@]")).select(F.xxhash64(F.col(id_col).cast("string")).alias("_h"), F.col(id_col).alias("_id"))
    wanted = wanted.filter(F.col("_id").isNotNull()).distinct().orderBy("_h", "_id").limit(SAMPLE_DOCS).select("_id")
    rows = texts.join(F.broadcast(wanted), "_id").groupBy("_id").agg(F.max("_text").alias("_text")).collect()  # at most SAMPLE_DOCS
    chosen = [r["_text"] for r in sorted(rows, key=lambda r: str(r["_id"])) if r["_text"]]
    x, y = examples(chosen)
    return train_tagger(x, y) if len(x) else None


# ---------------------------------------------------------------- whole texts


def _check(text: str, kind: int) -> bool:
    if kind == 0:
        return bool(re.search(r"[^@\s]@[^@\s]+\.[^@\s]", text)) and not re.search(r"\s", text)
    if kind == 1:
        return bool(_IP.fullmatch(text)) and _ip_ok(text)
    if kind == 2:
        return _card_ok(text) and bool(re.fullmatch(r"[0-9](?:[ .\-/]?[0-9])+", text))
    return bool(re.fullmatch(r"\(?[0-9][ ().0-9-]*[0-9]", text)) and 10 <= len(_DIGITS.findall(text)) <= 15 and bool(re.search(r"[ ().-]", text))


def _beside(text: str, c: tuple[int, int, int, float], base: list[Span]) -> bool:
    """Whether a candidate touches no pattern's span, or is an address that goes on, in letters the pattern does not
    know, where the pattern's ends."""
    met = [s for s in base if s[0] < c[2] and c[0] < s[2]]
    if not met:
        return True
    whole = c[1] == 0 and all(kind == 0 and c[0] <= start and end < c[2] for start, kind, end in met)
    return whole and any(x.isalpha() and not x.isascii() for x in text[met[-1][2] : c[2]])


def schedule(candidates: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The non-overlapping candidates (start, kind, end, weight) of greatest total weight."""
    ordered = sorted(set(candidates), key=lambda c: (c[2], c[0], c[1]))
    ends = [c[2] for c in ordered]
    total, choice = [0.0], []
    for k, (start, _, _, weight) in enumerate(ordered):
        before = bisect_right(ends, start, 0, k)
        take = total[before] + weight
        choice.append((take > total[k], before))
        total.append(max(take, total[k]))
    out, k = [], len(ordered)
    while k:
        took, before = choice[k - 1]
        if took:
            out.append(ordered[k - 1])
            k = before
        else:
            k -= 1
    return out[::-1]


def long_spans(windows: list[tuple[int, np.ndarray, np.ndarray]], length: int) -> list[tuple[int, int, int, float]]:
    """Spans longer than a stride, which may lie whole in no window: runs of labels in the windows' middle parts, which
    join without gap or overlap where windows follow one another."""
    out = []
    edge = (WINDOW - STRIDE) // 2
    kind, start, end, weight = -1, 0, 0, 0.0

    def close() -> None:
        if kind >= 0 and end - start > STRIDE and weight >= LEAST_WEIGHT * (end - start):
            out.append((start, kind, end, weight))

    for at, labels, gap in sorted(windows, key=lambda w: w[0]):
        lo = 0 if at == 0 else edge
        hi = len(labels) if at + len(labels) == length else edge + STRIDE
        marked = np.flatnonzero(labels[lo:hi]) + lo
        for i in marked.tolist():
            label = int(labels[i])
            if label % 2 == 0 and kind == label // 2 - 1 and end == at + i:
                end, weight = end + 1, weight + float(gap[i])
                continue
            close()
            kind = -1
            if label % 2 == 1:
                kind, start, end, weight = label // 2, at + i, at + i + 1, float(gap[i])
    close()
    return out


def find(texts: list[str], net: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """Pattern spans and further spans of each text."""
    base = [base_spans(t) for t in texts]
    if net is None:
        return [(b, []) for b in base]
    table = _class_table()
    found: list[list] = [[] for _ in texts]
    read: list[list] = [[] for _ in texts]
    queue: list[tuple[int, int, int, np.ndarray]] = []
    wide: dict[int, np.ndarray] = {}  # of rows with a span at a window's edge, to go on there
    queued: set[tuple[int, int]] = set()

    def ask(row: int, codes: np.ndarray, i: int) -> None:
        if (row, i) not in queued:
            queued.add((row, i))
            part = codes[i * STRIDE : i * STRIDE + WINDOW]
            queue.append((row, i * STRIDE, len(part), _padded(part, _PAD)))

    def flush() -> None:
        further: list[tuple[int, int]] = []
        x = np.array([q[3] for q in queue])
        path, margin = net.decode(x, np.array([q[1] == 0 for q in queue]))
        for (row, at, length, _), labels, gap in zip(queue, path, margin):
            read[row].append((at, labels[:length].astype(np.int8), gap[:length].astype(np.float32)))
            begins = np.flatnonzero(labels[:length] % 2 == 1)
            for b in begins:
                inside, e = labels[b] + 1, b + 1
                while e < length and labels[e] == inside:
                    e += 1
                cut_off = e == WINDOW and at + WINDOW < len(texts[row])
                if not cut_off:
                    weight = float(gap[b:e].mean())
                    if weight >= LEAST_WEIGHT:
                        found[row].append((at + int(b), int(labels[b] - 1) // 2, at + int(e), weight * int(e - b)))
            if at and labels[0]:
                further.append((row, at // STRIDE - 1))
            if at + WINDOW < len(texts[row]) and labels[WINDOW - 1]:
                further.append((row, at // STRIDE + 1))
        queue.clear()
        for row, i in further:  # spans reach into windows that hold no digit or at sign themselves
            if row not in wide:
                wide[row] = encode_chars(texts[row], table)
            ask(row, wide[row], i)

    for row, text in enumerate(texts):
        if not _TRIGGER.search(text):
            continue
        codes = encode_chars(text, table)
        hits = np.flatnonzero((codes == 3) | (codes == 6))
        last = max(0, -(-(len(text) - WINDOW) // STRIDE))  # the last window reaches the end of the text
        k = np.unique(np.concatenate([hits // STRIDE - d for d in range(WINDOW // STRIDE)]))
        for i in k[(k >= 0) & (k <= last)].tolist():
            ask(row, codes, i)
            if len(queue) >= DECODED:
                flush()
    while queue:
        flush()
    out = []
    for text, b, candidates, windows in zip(texts, base, found, read):
        candidates += long_spans(windows, len(text))
        free = [c for c in candidates if _check(text[c[0] : c[2]], c[1]) and _beside(text, c, b)]
        out.append((b, [(s, kind, e) for s, kind, e, _ in schedule(free)]))
    return out


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def redact(text: str, spans: list[Span]) -> str:
    """Spans replaced by their kind in brackets; of overlapping spans the first gives the name."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += (text[at:start], f"[{KINDS[kind].upper()}]")
        at = max(at, end)
    return "".join([*out, text[at:]])


# Characters of the texts searched together.
BLOCK_CHARS = 4_000_000


def _blocks(texts: list[str]):
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_CHARS:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


FOUND = "spans array<struct<kind: string, start: int, end: int, base: boolean>>, redacted string"


def _searcher(net: Tagger | None, with_text: bool):
    @F.pandas_udf(FOUND)
    def search(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in columns:
            values = texts.fillna("").tolist()
            rows = []
            for lo, hi in _blocks(values):
                for text, (base, more) in zip(values[lo:hi], find(values[lo:hi], net)):
                    marked = sorted([(s, k, e, True) for s, k, e in base] + [(s, k, e, False) for s, k, e in more])
                    spans = [{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in marked]
                    rows.append((spans, (redact(text, base + more) if spans else text) if with_text else None))
            yield pd.DataFrame(rows, columns=["spans", "redacted"])

    return search


def with_personal_data(docs: DataFrame, net: Tagger | None, text_col: str = "text", name: str = "pii", with_text: bool = True) -> DataFrame:
    """Add a struct: spans (kind, start, end in code points, base) and, unless left out, the redacted text. It is the last
    column, its name followed by an underscore if the documents have that name."""
    small_batches(docs.sparkSession)
    return docs.withColumn(unused(docs, name), _searcher(net, with_text)(F.col(f"`{text_col}`")))
