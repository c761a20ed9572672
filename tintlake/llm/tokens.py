"""Token ids of whole texts by the tokenizers library, memoised by pre-token.

A byte-pair vocabulary encodes each pre-token (a word with the space before it, a number, a run of signs) by itself,
so a text's ids are those of its pre-tokens, joined. Pre-tokens repeat, so most are looked up; new words are encoded
together, many a call, and parted again at their edges. Texts for which the two regular-expression dialects or the
normalisation could differ (numerals other than digits, some control characters, special-token markers, texts that are
not in composed form) are encoded whole by the library.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np

from tintlake.llm.common import worker_memory

_KEEPS_SPACE = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_DROPS_SPACE = re.compile(r"[^\W\d_]+|'(?:[stmd]|re|ve|ll)|\d|(?:[^\s\w]|_)+")
def _composed(text: str) -> bool:
    """Whether text and lower-case text are both in NFC (lower-casing can bring combining marks)."""
    return unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", text.lower())


_ODD = ("<|", "Σ", "\x1c", "\x1d", "\x1e", "\x1f")

# Pre-tokens remembered by one Python worker; the memory is emptied when it is full.
MEMORY_UNITS = 600_000
# Longer pre-tokens are not remembered.
MEMORY_CHARS = 18
# Words encoded by one call.
JOINED_WORDS = 20_000
# Characters of the texts that are encoded together.
BLOCK_CHARS = 1_000_000


class UnitEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids; ``drops_space``: the vocabulary has no ids for white space
    and lower-cases."""

    def __init__(self, path: str, drops_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = drops_space
        self.known: dict[str, bytes | None] = {}
        self.split = (_DROPS_SPACE if drops_space else _KEEPS_SPACE).findall
        edge = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            edge[i] = token.endswith("</w>") if drops_space else token.startswith("Ġ")
        self.edge = edge

    def direct(self, texts: list[str]) -> list[bytes]:
        """Ids by the library alone."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each with a space before it if the vocabulary keeps spaces.

        A word's ids begin with a token that holds the space, or end with one that holds the vocabulary's word end. If
        the count of words differs, each is encoded by itself."""
        out: list[bytes] = []
        for k in range(0, len(words), JOINED_WORDS):
            part = words[k : k + JOINED_WORDS]
            raw = self.direct([" " + " ".join(part)])[0]
            edges = np.flatnonzero(self.edge[np.frombuffer(raw, dtype="<u4")])
            if len(edges) != len(part):
                out += self.direct([w if self.drops_space else " " + w for w in part])
                continue
            cuts = [0, *(4 * edges + 4).tolist()] if self.drops_space else [*(4 * edges).tolist(), len(raw)]
            out += [raw[i:j] for i, j in zip(cuts, cuts[1:])]
        return out

    def _learn(self, units: Iterable[str]) -> None:
        joined, alone = [], []
        for unit in units:
            if self.drops_space:
                (joined if unit.isalpha() else alone).append(unit)
            elif unit[0] == " " and unit[1:].isalpha():
                joined.append(unit[1:])
            else:
                alone.append(unit)
        space = "" if self.drops_space else " "
        self.known.update(zip([space + w for w in joined] if space else joined, self._words(joined)))
        self.known.update(zip(alone, self.direct(alone)))
        for unit in alone:
            if any(c.isnumeric() and not c.isdecimal() for c in unit):
                self.known[unit] = None  # a numeral that the library may cut elsewhere

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        out: list[bytes] = [b""] * len(texts)
        plain: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(odd in text for odd in _ODD) or (self.drops_space and not text.isascii() and not _composed(text)):
                out[i] = self.direct([text])[0]
            else:
                plain.append((i, self.split(text.lower() if self.drops_space else text)))
        new = set(chain.from_iterable(u for _, u in plain)).difference(self.known)
        if len(self.known) + len(new) > MEMORY_UNITS:
            self.known = {}
            new = set(chain.from_iterable(u for _, u in plain))
        self._learn(new)
        ids = self.known.__getitem__
        for i, units in plain:
            try:
                out[i] = b"".join(map(ids, units))
            except TypeError:
                out[i] = self.direct([texts[i]])[0]
        for unit in [u for u in new if len(u) > MEMORY_CHARS]:
            del self.known[unit]
        return out


def encoder(path: str, drops_space: bool) -> UnitEncoder:
    """The worker's encoder of one vocabulary file."""
    memory = worker_memory("tokens")
    key = ("encoder", path, drops_space)
    if key not in memory:
        memory[key] = UnitEncoder(path, drops_space)
    return memory[key]


def encode_in_blocks(enc: UnitEncoder, texts: list[str | None]) -> Iterable[bytes]:
    """``enc.encode`` over blocks of bounded size, in order."""
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text or "")
        if size >= BLOCK_CHARS:
            yield from enc.encode(block)
            block, size = [], 0
    yield from enc.encode(block)
