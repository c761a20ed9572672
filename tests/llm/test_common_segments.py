"""Facts of a common mark or segment are repeated, those of others are not; spread or not, the same words go."""

import random

import pytest

from tintlake.llm import substring_dedup as sd

WINDOW, GRAM = 12, 4


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    line = [f"c{i}" for i in range(20)]
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for i in range(60):  # a common passage, cut and continued in many ways
        a, b = rng.randrange(4), 20 - rng.randrange(4)
        rows.append((i, " ".join([word() for _ in range(15)] + line[a:b] + [word() for _ in range(15)])))
    rows += [(100 + i, rows[i % 7][1]) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute(rows):
    texts = [t.split() for _, t in rows]
    seen = {}
    for w in texts:
        for a in range(len(w) - WINDOW + 1):
            seen[tuple(w[a : a + WINDOW])] = seen.get(tuple(w[a : a + WINDOW]), 0) + 1
    out = {}
    for (i, _), w in zip(rows, texts):
        gone = {k for a in range(len(w) - WINDOW + 1) if seen[tuple(w[a : a + WINDOW])] > 1 for k in range(a, a + WINDOW)}
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone).encode()
    return out


def kept(docs):
    return {r["doc_id"]: bytes(r["kept"]) for r in sd.remove_repeats(docs, window=WINDOW, gram=GRAM).collect()}


def test_few_rows_are_not_repeated(docs, monkeypatch):
    """Every fact is joined once here: in so small a table no mark is a burden to a task."""
    calls, join = [], sd._spread_join

    def spy(rows, facts, keys, common, place):
        calls.append(facts.join(common, common.columns).count())
        return join(rows, facts, keys, common, place)

    monkeypatch.setattr(sd, "_spread_join", spy)
    assert kept(docs) == brute([tuple(r) for r in docs.collect()])
    assert calls == [0, 0, 0]


def test_common_rows_are_spread(docs, monkeypatch):
    monkeypatch.setattr(sd, "COMMON_ROWS", 2)
    assert kept(docs) == brute([tuple(r) for r in docs.collect()])
