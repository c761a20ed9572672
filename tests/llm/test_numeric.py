"""Parts that need no Spark: automata, signatures, plans, matrices, matching, network."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tintlake.llm import decontaminate, minhash, packing, pii, quality, search, substring_dedup, tokens, wavelet
from tintlake.llm.common import word_bounds, word_hashes


def test_suffix_automaton_counts_windows():
    r = random.Random(1)
    for _ in range(60):
        words = [[r.choice("ab") for _ in range(r.randint(3, 12))] for _ in range(r.randint(1, 4))]
        weights = [r.randint(1, 2) for _ in words]
        symbols, ends = [], []
        for i, (w, n) in enumerate(zip(words, weights)):
            symbols += [*w, i]
            ends += [n] * len(w) + [1]
        seen = Counter()
        for w, n in zip(words, weights):
            for a in range(len(w) - 2):
                seen[tuple(w[a : a + 3])] += n
        automaton = substring_dedup.SuffixAutomaton(symbols, ends)
        for w in words:
            assert automaton.repeated(w, 3) == [a for a in range(len(w) - 2) if seen[tuple(w[a : a + 3])] > 1]


def test_leftmost_minima():
    v = np.random.default_rng(0).integers(0, 5, 200)
    for width in (1, 2, 3, 7, 28):
        want = [i + int(v[i : i + width].argmin()) for i in range(len(v) - width + 1)]
        assert substring_dedup.leftmost_minima(v, width).tolist() == want


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(2)
    for trial in range(4):
        ids = r.integers(0, 1 << 50, 60).astype(np.uint64)
        a, b = r.integers(0, 9, 60), r.integers(0, 9, 60)
        rows = [np.flatnonzero(a), np.flatnonzero(b)]
        row = np.repeat([0, 1], [len(x) for x in rows])
        sig = minhash.bag_minhash(row, np.concatenate([ids[x] for x in rows]), np.concatenate([a[rows[0]], b[rows[1]]]), 2, 1024)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 1024)


def test_signature_beyond_the_horizon_is_the_same():
    shingle, count = np.array([5, 9, 77], dtype=np.uint64), np.array([1, 6, 3])
    fast = minhash.bag_minhash(np.zeros(3, dtype=int), shingle, count, 1, 64)[0]
    assert np.array_equal(fast, minhash._without_horizon(shingle, count, 64))


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_plan_places_every_piece_once(seed):
    r = random.Random(seed)
    cap = r.choice([10, 64, 2048])
    counts = Counter(r.randint(1, cap) for _ in range(r.randint(1, 800)))
    plan, sequences = packing.best_fit_plan(dict(counts), cap)
    used = {}
    for length, n in counts.items():
        ranks = sorted((p[1], p[2]) for p in plan.tolist() if p[0] == length)
        at = 0
        for first, k in ranks:
            assert first == at
            at += k
        assert at == n
    for length, _, n, each, first, offset in plan.tolist():
        for j in range(n):
            used.setdefault(first + j // each, []).append((offset + j % each * length, length))
    assert sorted(used) == list(range(sequences))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= cap
    total = sum(k * n for k, n in counts.items())
    assert -(-total // cap) <= sequences <= -(-total // cap) * 1.25 + 1


@pytest.mark.parametrize("top", [1, 2, 7, 300, 49407, 70000])
def test_wavelet_matrix(top):
    r = np.random.default_rng(top)
    ids = r.integers(0, top, 3000).astype(np.uint32)
    data = wavelet.to_bytes(ids, [None, 4], [1000, 2000])
    m, doc_ids, lengths = wavelet.from_bytes(data)
    assert doc_ids == [None, 4] and lengths.tolist() == [1000, 2000]
    assert np.array_equal(m.decode(), ids)
    for i in r.integers(0, 3000, 60).tolist():
        token = int(ids[i])
        assert m.access(i) == token
        assert m.rank(token, i) == int((ids[:i] == token).sum())
        assert m.select(token, m.rank(token, i)) == i
    assert m.count(top + 5) == 0 and m.select(int(ids[0]), 3000) == -1


def test_wavelet_of_nothing():
    m, doc_ids, _ = wavelet.from_bytes(wavelet.to_bytes(np.zeros(0, np.uint32), [], []))
    assert m.decode().tolist() == [] and doc_ids == []


def test_ids_equal_the_library_on_odd_texts():
    r = random.Random(5)
    parts = ["a", "b", "É", "é", "1", "²", "½", " ", "  ", "\n", "\t", "'s", "'", " ", "中", "_", "-", "!!", "<|endoftext|>", "Σ", "İ", "\x1c", "٣", "Ⅷ", "ß", "́", "😀", "word", "it's "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)] + ["x" * 5000, None]
    for name, drops in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        e = tokens.encoder(public_tokenizers.path(name), drops)
        assert list(tokens.encode_in_blocks(e, texts)) == e.direct([t or "" for t in texts])


def distance(item, text):
    """Least edit distance of the item to any substring, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_against_the_table():
    r = random.Random(3)
    for _ in range(200):
        item = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
        text = "".join(r.choice("abc") for _ in range(r.randint(0, 30)))
        got = decontaminate.myers(item, text, 99)
        assert got is not None and got[0] == distance(item, text) if text else True


def test_matcher_finds_what_the_budget_allows():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(12)]
    m = decontaminate.Matcher(items, 0.06)
    for i, item in items:
        budget = int(0.06 * len(item))
        for edits in (0, 1, budget, 3 * budget):
            chars = list(item)
            for _ in range(edits):
                k = r.randrange(len(chars))
                chars[k : k + 1] = r.choice([[], ["z"], [chars[k], "z"]])
            text = " ".join(word() for _ in range(9)) + " " + "".join(chars) + " " + " ".join(word() for _ in range(9))
            hits = [h for h in m.find(text) if h[0] == i]
            least = distance(item, text)
            assert bool(hits) == (least <= budget)
            if hits:
                assert min(h[1] for h in hits) == least
    assert m.find("nothing of the kind here") == [] and m.find("") == []


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pattern_spans_on_odd_texts():
    r = random.Random(6)
    parts = ["@", ".", "a", "b.c", "1", "25", "255", "256", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "x@y.z", "1.2.3.4", "+1 (743) 555-3824", "é", "\n", "0000"]
    for _ in range(8000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("9" * 20_000 + "@" * 20_000 + "a" * 20_000) == []


def test_network_gradients():
    r = np.random.default_rng(0)
    x, y = r.integers(0, pii.CLASSES, (3, 9)), r.integers(0, pii.LABELS, (3, 9))
    net = pii.Tagger.fresh()
    for name in ("wx", "u", "v", "bias", "moves"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    _, grads = net.gradients(x, y)
    for name, g in zip(("wx", "u", "v", "bias", "moves"), grads):
        p, k = getattr(net, name), np.unravel_index(np.abs(g).argmax(), g.shape)
        at = p[k]
        p[k] = at + 1e-3
        above = net.gradients(x, y)[0]
        p[k] = at - 1e-3
        below = net.gradients(x, y)[0]
        p[k] = at
        assert abs((above - below) / 2e-3 - g[k]) < 1e-3


def test_viterbi_is_the_best_path():
    net = pii.Tagger.fresh(3)
    net.moves += np.random.default_rng(1).standard_normal(net.moves.shape).astype(np.float32)
    x = np.random.default_rng(2).integers(0, pii.CLASSES, (2, 4))
    e, ok = net.emissions(x), pii.allowed_moves()
    path, _ = net.decode(x)
    for b in range(2):
        def score(p, b=b):
            if p[0] and p[0] % 2 == 0 or any(not ok[i, j] for i, j in itertools.pairwise(p)):
                return -1e9
            return sum(e[t, b, k] for t, k in enumerate(p)) + sum(net.moves[i, j] for i, j in itertools.pairwise(p))
        assert abs(score(path[b].tolist()) - max(score(p) for p in itertools.product(range(pii.LABELS), repeat=4))) < 1e-3


def test_schedule_is_optimal():
    r = random.Random(8)
    for _ in range(100):
        c = [(s := r.randint(0, 20), r.randint(0, 3), s + r.randint(1, 8), r.random()) for _ in range(r.randint(0, 8))]
        best = 0.0
        for k in range(len(c) + 1):
            for part in itertools.combinations(c, k):
                if all(a[2] <= b[0] or b[2] <= a[0] for a, b in itertools.combinations(part, 2)):
                    best = max(best, sum(x[3] for x in part))
        got = pii.schedule(c)
        assert abs(sum(x[3] for x in got) - best) < 1e-9 and all(a[2] <= b[0] for a, b in itertools.pairwise(got))


def test_network_learns_and_generalises():
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("aeiounrst") for _ in range(r.randint(2, 8))) for _ in range(n))
    def made():
        kind = r.randrange(4)
        digits = "".join(r.choice("0123456789") for _ in range(15))
        card = next(digits + d for d in "0123456789" if pii.luhn(digits + d))
        return [f"{words(1)}{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", ".".join(str(r.randint(1, 255)) for _ in range(4)), card, f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"][kind]
    texts = [f"{words(12)} {made()} {words(12)} version {r.randint(1, 9)}.{r.randint(0, 9)} of {words(4)}" for _ in range(500)]
    x, y = pii.examples(texts[:400])
    net = pii.train_tagger(x, y, steps=300)
    hx, hy = pii.examples(texts[400:], seed=11)
    path, _ = net.decode(hx)
    assert (path == hy).mean() > 0.95
    found = [bool(more) for _, more in pii.find([f"{words(8)} 743.555.{n} {words(8)}" for n in range(1000, 1060)], net)]
    assert sum(found) > 40
    clean = [f"{words(10)} in {r.randint(1900, 2030)} of {words(5)}" for _ in range(200)]
    assert sum(bool(more) for _, more in pii.find(clean, net)) <= 2
    long = words(9000) + " 743.555.1234 " + words(3000)
    (base, more), = pii.find([long], net)
    assert base == [] and all(long[a:b].strip("0123456789.") == "" for a, _, b in more)


@pytest.mark.parametrize("seed", range(6))
def test_wand_equals_full_scoring(seed):
    r = random.Random(seed)
    n = 700
    lengths = [r.randint(1, 60) for _ in range(n)]
    ids = list(range(n))
    r.shuffle(ids)
    mean = sum(lengths) / n
    lists = []
    for _ in range(r.randint(1, 6)):
        docs = sorted(r.sample(range(n), r.choice([1, 5, 80, 500])))
        lists.append(([(d, r.choice([1, 1, 1, 2, 9])) for d in docs], r.random() * 4))
    scores = Counter()
    for posting, weight in lists:
        for d, tf in posting:
            scores[d] += weight * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * lengths[d] / mean))
    want = sorted(((-round(s, 6), ids[d]) for d, s in scores.items()))[:10]
    cursors = []
    for posting, weight in lists:
        p = np.array(posting, dtype="<u4")
        cuts = range(0, len(p), search.BLOCK)
        blocks = np.array([(p[min(c + search.BLOCK, len(p)) - 1, 0], p[c : c + search.BLOCK, 1].max(), min(lengths[d] for d in p[c : c + search.BLOCK, 0])) for c in cuts], dtype="<u4")
        cursors.append(search.Postings(p.tobytes(), blocks.tobytes(), weight, mean))
    assert [(-s, i) for s, i in search.wand(cursors, lengths, ids, mean, 10)] == want


def test_rules_compile_to_what_they_were_fitted_as():
    r = np.random.default_rng(5)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.6) & (x[:, 2] <= 0.5)).astype(float)
    flip = r.random(3000) < 0.03
    y[flip] = 1 - y[flip]
    model = quality.fit_rules(x[:2000], y[:2000], ["a", "b", "c", "d"])
    z = np.full(1000, model.intercept)
    for rule, weight in model.rules:
        hit = np.ones(1000, dtype=bool)
        for name, above, cut in rule:
            v = x[2000:, "abcd".index(name)]
            hit &= (v > cut) if above else (v <= cut)
        z += weight * hit
    assert ((z > 0) == y[2000:]).mean() > 0.94
    assert quality.fit_rules(np.zeros((0, 4)), np.zeros(0)).intercept > 0
    assert quality.fit_rules(np.zeros((3, 4)), np.zeros(3)).intercept < 0


def test_word_bounds_split_like_bytes():
    r = random.Random(7)
    texts = ["".join(r.choice("ab é\t\n\x0b\x0c\r\x1c\xa0") for _ in range(r.randint(0, 20))) for _ in range(500)]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    starts, ends, first = word_bounds(data, offsets)
    raw = data.tobytes()
    seen = {}
    hashes = word_hashes(data, starts, ends)
    for k, t in enumerate(texts):
        words = [raw[a:b] for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])]
        assert words == t.encode().split()
        for w, h in zip(words, hashes[first[k] : first[k + 1]]):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shard_file_checks_its_head():
    with pytest.raises(ValueError):
        wavelet.from_bytes(b"X" * 64)
    assert zlib.crc32(b"") == 0
