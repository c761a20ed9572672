"""Secret scan with a trigram inverted index.

From each rule's regular expression follows a Boolean query over trigrams: what every match must contain. Texts are
indexed in shards, one per block of texts: each trigram that a query names has the sorted list of the rows that hold it.
A rule's query is answered by intersecting and uniting such lists, and only the rows that remain are searched with the
expression. A rule without mandatory trigrams searches every row. Trigrams are of UTF-8 bytes with A-Z lowered, on both
sides, so one index serves rules that look at case and rules that do not.

A shard lives and goes with its block, so nothing is shuffled and no list grows with the corpus.

Nulls: a null text counts as empty and holds nothing. Repeated rows are searched each; all columns of the input are
kept as they are; the result is the last column, its name followed by an underscore if the input has that name. Matches are leftmost and do not overlap within
a rule; a match that fails the rule's further conditions is dropped, and the search goes on behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintlake.llm.common import small_batches, text_blocks, unused


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``group`` needs; ``whole``: an expression that a match must fit in full."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    whole: str | None = None
    base: bool = False


def either(word: str) -> str:
    """The word with each ASCII letter in either case, and no other letter that folding might add."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
# Runs of letters that are too short fail whole, so asking for the length at once gives the same spans.
RULES = [
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12, base=True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z\x20]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_.-]+", whole=r"[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
]


# ---------------------------------------------------------------- trigram queries

# A query: None (every row), a trigram's code, or ("and" | "or", queries).
Query = None | int | tuple[str, tuple]
# Strings of a set, and letters of a class, up to which they are listed.
MOST_STRINGS, MOST_LETTERS = 64, 16


def both(*queries: Query) -> Query:
    parts = {p for q in queries if q is not None for p in (q[1] if isinstance(q, tuple) and q[0] == "and" else (q,))}
    return None if not parts else parts.pop() if len(parts) == 1 else ("and", tuple(sorted(parts, key=repr)))


def any_of(queries: Iterable[Query]) -> Query:
    parts = set(queries)
    if None in parts or not parts:
        return None
    asks = {p: frozenset(p[1]) if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in parts}
    parts = {p for p in parts if not any(asks[q] < asks[p] for q in parts)}  # whoever asks for more adds no row
    return parts.pop() if len(parts) == 1 else ("or", tuple(sorted(parts, key=repr)))


def trigrams(text: bytes) -> Query:
    return both(*[int.from_bytes(text[i : i + 3], "big") for i in range(len(text) - 2)])


def holds(strings: Iterable[bytes]) -> Query:
    """A text with one of the strings."""
    return any_of(trigrams(s) for s in strings)


@dataclass(frozen=True)
class Shape:
    """What matches of an expression look like: all of them (``exact``) if they are few, else how they begin, how they
    end, and what they hold."""

    exact: frozenset[bytes] | None
    begins: frozenset[bytes]
    ends: frozenset[bytes]
    need: Query

    @classmethod
    def of(cls, strings: Iterable[bytes]) -> Shape:
        all_ = frozenset(strings)
        if len(all_) <= MOST_STRINGS:
            return cls(all_, all_, all_, None)
        return cls(None, frozenset(s[:2] for s in all_), frozenset(s[-2:] for s in all_), holds(all_))

    def query(self) -> Query:
        if self.exact is not None:
            return holds(self.exact)
        return both(self.need, holds(self.begins), holds(self.ends))


_NOTHING = frozenset([b""])
ANYTHING = Shape(None, _NOTHING, _NOTHING, None)


def _short(strings: set[bytes], at_end: bool) -> frozenset[bytes]:
    if len(strings) > MOST_STRINGS:
        strings = {s[-2:] if at_end else s[:2] for s in strings}
    return frozenset(strings) if len(strings) <= MOST_STRINGS else _NOTHING


def _followed(x: Shape, y: Shape) -> Shape:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MOST_STRINGS:
        return Shape.of(a + b for a in x.exact for b in y.exact)
    seam = holds(a + b for a in x.ends for b in y.begins) if len(x.ends) * len(y.begins) <= MOST_STRINGS**2 else None
    begins = {a + b for a in x.exact for b in y.begins} if x.exact is not None else x.begins
    ends = {a + b for a in x.ends for b in y.exact} if y.exact is not None else y.ends
    return Shape(None, _short(begins, False), _short(ends, True), both(x.query(), y.query(), seam))


def _one_of(shapes: list[Shape]) -> Shape:
    if all(s.exact is not None for s in shapes):
        return Shape.of(x for s in shapes for x in s.exact)
    begins, ends = (set().union(*(getattr(s, f) for s in shapes)) for f in ("begins", "ends"))
    return Shape(None, _short(begins, False), _short(ends, True), any_of(s.query() for s in shapes))


def _letters(chars: Iterable[int]) -> Shape:
    return Shape.of(chr(c).encode("utf-8", "surrogatepass").lower() for c in chars)  # bytes.lower is ASCII's


def _class(items) -> Shape:
    codes: set[int] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            codes.add(value)
        elif kind is op.RANGE and value[1] - value[0] < 2 * MOST_LETTERS:
            codes.update(range(value[0], value[1] + 1))
        else:
            return ANYTHING
    shape = _letters(codes)
    return shape if shape.exact is not None and len(shape.exact) <= MOST_LETTERS else ANYTHING


def _shape(nodes) -> Shape:
    out = Shape.of([b""])
    for kind, value in nodes:
        if kind is op.LITERAL:
            part = _letters([value])
        elif kind is op.IN:
            part = _class(value)
        elif kind is op.BRANCH:
            part = _one_of([_shape(x) for x in value[1]])
        elif kind is op.SUBPATTERN:
            part = _shape(value[3])
        elif kind is op.ATOMIC_GROUP:
            part = _shape(value)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            one = _shape(inner)
            part = Shape.of([b""])
            for _ in range(min(least, 3)):
                part = _followed(part, one)
            if (least, most) == (0, 1):
                part = _one_of([part, one])
            elif most > min(least, 3):
                part = _followed(part, ANYTHING)
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue
        else:  # any character, negated letters, references
            part = ANYTHING
        out = _followed(out, part)
    return out


def trigram_query(pattern: str) -> Query:
    """What a text must hold to have a match. Expressions that ignore case do so for ASCII only (``re.ASCII``)."""
    return _shape(_parser.parse(pattern, re.ASCII)).query()


def named(query: Query) -> set[int]:
    """The trigrams of a query."""
    if query is None or isinstance(query, int):
        return set() if query is None else {query}
    return set().union(*(named(q) for q in query[1]))


# ---------------------------------------------------------------- index

_LOWER = np.arange(256, dtype=np.int32)
_LOWER[ord("A") : ord("Z") + 1] += 32


class TrigramShard:
    """Postings of the wanted trigrams of a block of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray):
        """``wanted``: one boolean per trigram code."""
        self.rows = np.arange(len(offsets) - 1)
        low = _LOWER[data]
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        at = np.flatnonzero(wanted[codes])
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[row + 1]
        pairs = np.unique((codes[at[inside]].astype(np.int64) << 32) | row[inside])
        of, starts = np.unique(pairs >> 32, return_index=True)
        self.postings = dict(zip(of.tolist(), np.split(pairs & 0xFFFFFFFF, starts[1:])))

    def answer(self, query: Query) -> np.ndarray:
        """Rows that satisfy a query, ascending."""
        if query is None:
            return self.rows
        if isinstance(query, int):
            return self.postings.get(query, self.rows[:0])
        parts = [self.answer(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        rows = parts[0]
        for other in parts[1:]:
            rows = np.intersect1d(rows, other, assume_unique=True)
        return rows


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), re.compile(r.whole, re.ASCII) if r.whole else None, trigram_query(r.pattern)) for r in rules]
        self.wanted = np.zeros(1 << 24, dtype=bool)
        self.wanted[sorted(set().union(*(named(q) for *_, q in self.rules)))] = True

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of each row's spans by start, then rule; code points, end exclusive."""
        shard = TrigramShard(data, offsets, self.wanted)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        raw, texts = data.tobytes(), {}
        for k, (rule, pattern, whole, query) in enumerate(self.rules):
            for row in shard.answer(query).tolist():
                text = texts.get(row)
                if text is None:
                    text = texts[row] = raw[offsets[row] : offsets[row + 1]].decode()
                for m in pattern.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least and (whole is None or whole.fullmatch(m[0])):
                        found[row].append((m.start(), k, m.end()))
        for spans in found:
            spans.sort()
        return found


RESULT = "struct<spans: array<struct<kind: string, start: int, end: int, base: boolean>>, masked: string>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def mask(text: str, spans: list[tuple[int, str, int]]) -> str:
    """Spans replaced by their kind in brackets; where they overlap the first gives the name."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += (text[at:start], f"[{kind.upper()}]")
        at = max(at, end)
    return "".join([*out, text[at:]])


def with_secrets(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text", name: str = "secrets", with_text: bool = True) -> DataFrame:
    """Add a struct: spans (kind, start, end in code points, base) and, unless left out, the text with its spans masked."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(RESULT)
    def search(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(rules)
        for texts in columns:
            spans, masked = [], []
            for first, n, data, offsets in text_blocks(pa.RecordBatch.from_arrays([texts], ["_text"])):
                for k, row in enumerate(scanner.scan(data, offsets)):
                    spans.append([{"kind": rules[r].kind, "start": s, "end": e, "base": rules[r].base} for s, r, e in row])
                    if with_text:
                        text = texts[first + k].as_py() or ""
                        masked.append(mask(text, [(s, rules[r].kind, e) for s, r, e in row]))
            if not with_text:
                masked = [None] * len(spans)
            yield pa.StructArray.from_arrays([pa.array(spans, _SPANS), pa.array(masked, pa.string())], ["spans", "masked"])

    return docs.withColumn(unused(docs, name), search(F.col(f"`{text_col}`")))
