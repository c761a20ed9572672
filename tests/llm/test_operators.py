"""Operators on small tables: brute force, nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import json
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import check
from tintlake.llm import decontaminate, minhash, packing, pii, quality, search, substring_dedup, tool_calls, url_filter, wavelet
from tintlake.llm.components import components
from tintlake.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ROWS = [
    (1, "a b c d e f g h", 7), (2, None, 7), (3, "", 7), (None, "null id text here now", 7), (4, LONG, 7), (5, "twice the same row of words", 7), (5, "twice the same row of words", 7),
    (5, "same id and other words entirely", 7), (6, " \n\t ", 7), (7, "one", None), (None, None, None),
]
CLASHES = ["_id", "_k1", "_k2", "node", "score", "spans", "part", "label", "_row", "matches", "text_", "words", "n"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, extra int")
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def plain_repeats(texts, window):
    words = [(t or "").split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


@pytest.mark.parametrize("common", [0, 20, 10_000])
@pytest.mark.parametrize("limit", [3000, 1])
def test_substring_dedup(spark, monkeypatch, limit, common):
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", limit)
    monkeypatch.setattr(substring_dedup, "COMMON_MARKS", common)
    r = random.Random(limit)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 30))) for _ in range(20)]
    texts += [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 60))) for _ in range(60)]
    common = " ".join(r.choice("ijklm") for _ in range(14))
    texts += [" ".join(r.choice("nopqrstu") for _ in range(5)) + " " + common + " " + r.choice("vw") for _ in range(15)] + ["x y " * 20, "z " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.doc_id: x for x in substring_dedup.remove_repeats(docs, window=7, gram=3).collect()}
    for k, kept in enumerate(plain_repeats(texts, 7)):
        assert bytes(got[k].kept).decode().split() == kept, texts[k]
        assert got[k].n_words == len(texts[k].split()) and got[k].n_removed == got[k].n_words - len(kept)


def test_substring_dedup_odd_rows(odd, none):
    rows = [r for r in substring_dedup.remove_repeats(odd, window=5, gram=2).collect()]
    assert len(rows) == len(ROWS)
    want = collections.Counter((i, " ".join(k)) for (i, _, _), k in zip(ROWS, plain_repeats([t for _, t, _ in ROWS], 5)))
    assert collections.Counter((r.doc_id, bytes(r.kept).decode()) for r in rows) == want
    assert substring_dedup.remove_repeats(none).count() == 0


def bags(text):
    w = (text or "").split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or collections.Counter([tuple(w)] if w else [])


def plain_classes(rows):
    bag = [bags(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, whole = sum((bag[i] & bag[j]).values()), sum((bag[i] | bag[j]).values())
            if (both >= 0.8 * whole) if whole else True:
                top[find(i)] = find(j)
    heads = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            heads[find(k)] = min(i, heads.get(find(k), i))
    return [heads.get(find(k)) for k in range(len(rows))]


def test_near_duplicates(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(40, 120))]
        for _ in range(r.randint(1, 7)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows) * 3, " ".join(copy)))
    rows += [(5000 + k, "spam ham " * 30 + word() * (k % 2)) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs).collect()}
    assert [got[i] for i, _ in rows] == plain_classes(rows)


def test_near_duplicates_odd_rows(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    want = plain_classes([(i, t) for i, t, _ in ROWS])
    assert collections.Counter(map(tuple, rows)) == collections.Counter((i, c) for (i, _, _), c in zip(ROWS, want))
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(False, 1, ROWS[0][1]), (False, 2, ""), (True, 0, ROWS[3][1]), (False, 4, LONG), (False, 5, ROWS[5][1]), (False, 5, ROWS[7][1]), (False, 7, "one")])
    assert minhash.near_duplicates(none).count() == 0 and minhash.keep_one(none).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (20, 21), (5, 5), (30, 31), (31, 32), (32, 33), (33, 34), (34, 35), (2, 1)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 5: 5, **{k: 30 for k in range(30, 36)}}


def test_packing(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(odd, path, capacity=256, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(path)
    want = collections.Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])) for i, t, _ in ROWS)
    docs, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert r.length == len(ids) <= 256 and r.ids_crc32 == zlib.crc32(ids.tobytes())
        places[r.sequence_id].append((r.offset, r.length))
        if r.doc_id == 4:
            docs[r.doc_id].append((r.piece, r.start, tuple(ids.tolist())))
        else:
            assert r.piece == 0 and want[r.doc_id, tuple(ids.tolist())] > 0
    parts = sorted(docs[4])
    assert [p for p, _, _ in parts] == list(range(len(parts))) and all(len(x) == 256 for _, _, x in parts[1:])
    assert sum((x for _, _, x in parts), ()) in {ids for i, ids in want if i == 4}
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
    assert packing.pack_documents(none, path).count() == 0


def test_token_shards(spark, odd, none, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = f"file://{tmp_path}/shards"
    wavelet.write_token_shards(odd, folder, path, shard_tokens=500)
    rows = wavelet.read_documents(spark, folder, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(path)
    want = collections.Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, _ in ROWS)
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in rows) == want
    at, order = 0, []
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        order.append(r.doc_id)
    known = [i for i in order if i is not None]
    assert order[:2] == [None, None] and known == sorted(known)
    ends = sorted(x.position for x in wavelet.occurrences(spark, folder, 1).collect())
    assert [r.start + r.n_tokens - 1 for r in sorted(rows, key=lambda r: r.start)] == ends
    wavelet.write_token_shards(none, folder + "0", path)
    assert wavelet.read_documents(spark, folder + "0").count() == 0


def test_search_odd_rows(spark, odd, none):
    queries = spark.createDataFrame([(20, "words of the same row"), (40, None), (60, "unknown zzz"), (None, "one"), (80, "W5 w6")], "item_id bigint, text string")
    index = search.build_index(odd)
    got = search.top_k(index, queries, "item_id", "text", k=3).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r["query"]].append(r.doc_id)
    assert by == {20: [5, 5, 5], None: [7], 80: [4]}
    assert search.top_k(search.build_index(none), queries, "item_id", "text").count() == 0
    assert search.top_k(index, queries.limit(0), "item_id", "text").count() == 0


def test_url_rules(spark):
    r = random.Random(12)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "a.net", "xa.com", "com", "", "A.com"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/xy/z", "?q=/x/", "#/x"]
    urls = [(k, f"http://{r.choice(hosts)}{r.choice(paths)}") for k in range(300)] + [(900, None), (None, "https://a.com/x/"), (901, "no scheme"), (902, ""), (903, "u://a.com/x/"), (903, "u://a.com/x/"), (904, "u://" + "d." * 5000 + "a.com/" + "x/" * 5000)]
    rules = [("com", "/", "allow"), ("a.com", "/x/", "block"), ("b.a.com", "/", "allow"), ("a.com", "/x", "allow"), ("net", "", "block"), ("c.b.a.com", "/x/y", "block"), (None, "/", "block"), ("b.a.com", "/x/", "block"), ("b.a.com", "/x/", "allow")]
    want = collections.Counter()
    for i, u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, 0, None, "allow"))
        want[i, host, path, best[3], best[4]] += 1
    pages = spark.createDataFrame(urls, "page_id bigint, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "key", "part", "_id", "_url")})
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filter.judge(pages, table)
    assert collections.Counter(map(tuple, got.collect())) == want
    assert url_filter.judge(pages.limit(0), table).count() == 0
    assert {x.verdict for x in url_filter.judge(pages, table.limit(0)).collect()} == {"allow"}


def test_decontamination_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "twice the SAME   row of words"), (1, "twice the SAME   row of words"), (2, None), (3, ""), (None, "w5 w6 w7 w8 w9"), (9, "not in any of these texts at all")], "item_id bigint, text string")
    got = decontaminate.contaminated(odd, items).collect()
    assert collections.Counter((r.doc_id, r.item_id, r.distance) for r in got) == collections.Counter({(5, 1, 0): 2, (4, None, 0): 1})
    assert [r.places for r in got if r.doc_id == 4] == [sum(1 for k in range(60_000 - 4) if k % 977 == 5)]
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.contaminated(odd, items.limit(0)).count() == 0


def test_personal_data_odd_rows(spark, odd, none):
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(50, "mail bob@mail.example.com or call +1 (743) 555-3824 é"), (51, None)], "doc_id bigint, text string"))
    docs = docs.withColumn("spans", F.lit(1))
    got = {r.doc_id: r.pii for r in pii.with_personal_data(docs, None).collect()}
    assert [(s.kind, s.start, s.end) for s in got[50].spans] == [("email", 5, 25), ("phone", 34, 51)]
    assert got[50].redacted == "mail [EMAIL] or call [PHONE] é" and got[51].redacted == "" and got[4].redacted == LONG
    assert pii.train(none) is None and pii.train(docs.filter("doc_id < 7")) is None
    assert pii.with_personal_data(none, None).count() == 0


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, int(k > 4), None) for k in (1, 2, 3, 4, 5, 5, 7)] + [(None, 1, 0), (99, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(odd, labels)
    rows = quality.score(odd, model, name="q").collect()
    assert len(rows) == len(ROWS) and all(0 <= r.q <= 1 for r in rows) and rows[0].score == "x"
    same = collections.defaultdict(set)
    for r in rows:
        same[r.text or ""].add(r.q)
    assert all(len(v) == 1 for v in same.values())
    assert quality.score(none, model, name="q").count() == 0
    assert quality.train(none, labels).rules == [] and quality.train(odd, labels.limit(0)).intercept == 40.0
    folds = {r.doc_id: r.h for r in odd.select("doc_id", quality.held_out("doc_id").alias("h")).collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, h in folds.items())


def test_quality_held_out(spark):
    rows = QUERIES["op10_quality_rules"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    got = {r.doc_id: r for r in rows}
    labels = duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall()
    tested = [(got[i].predicted, q) for i, q in labels if got[i].held_out]
    assert len(tested) > 50 and sum(p == q for p, q in tested) / len(tested) > 0.95


def test_tool_calls(spark):
    call = lambda i, name="ask", args=None, after=(): {"id": i, "name": name, "arguments": json.dumps({"prompt": "é", "turn": 1} if args is None else args), "after": list(after)}
    lines = [
        ("a", 0, json.dumps({"tool_calls": [call("3", after=["1", "2"]), call("1"), call("2", after=["1", "gone"])]})),
        ("a", 1, json.dumps({"tool_call_id": "1", "content": "one\n"})), ("a", 2, json.dumps({"tool_call_id": "1", "content": "zwei"})), ("a", 3, json.dumps({"tool_call_id": "9", "content": None})),
        ("b", 0, json.dumps({"tool_calls": [call("1", after=["2"]), call("2", after=["1"]), call("3", after=["2"]), call("4", after=["4"])]})),
        ("c", 0, json.dumps({"tool_calls": [call("1", name="tell"), call("2", args={"prompt": 1, "turn": 1}), call("3", args=[1]), call("4"), call("4"), call(None)]})),
        ("c", 1, json.dumps({"tool_call_id": "4", "content": "x"})), ("c", 2, "plain words"), ("c", 3, None), (None, 0, json.dumps({"tool_calls": [call("1")]})), (None, 1, json.dumps({"tool_call_id": "1", "content": "of null"})),
    ]
    calls, results = tool_calls.read_messages(spark.createDataFrame(lines, "conv_id string, turn int, text string").withColumn("m", F.lit(1)))
    schema = {"properties": {"prompt": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["prompt"]}
    schemas = spark.createDataFrame([("ask", json.dumps(schema))], "name string, schema string")
    rows = tool_calls.link_tool_calls(calls, results, schemas).collect()
    got = {(r.conv_id, r.call_id, r.status): r for r in rows}
    assert {k: (v.position, v.depth) for k, v in got.items()} == {
        ("a", "1", "ok"): (0, 0), ("a", "2", "no_result"): (1, 1), ("a", "3", "no_result"): (2, 2), ("a", "9", "no_call"): (None, None),
        ("b", "1", "cycle"): (None, None), ("b", "2", "cycle"): (None, None), ("b", "3", "cycle"): (None, None), ("b", "4", "cycle"): (None, None),
        ("c", "1", "unknown_tool"): (1, 0), ("c", "2", "bad_arguments"): (2, 0), ("c", "3", "bad_arguments"): (3, 0), ("c", "4", "ok"): (4, 0), ("c", "4", "repeated"): (None, None),
        ("c", None, "no_result"): (0, 0), (None, "1", "ok"): (0, 0),
    }
    assert got["a", "1", "ok"].json == '{"arguments":{"prompt":"é","turn":1},"id":"1","name":"ask","result":"one\\n"}'
    assert got[None, "1", "ok"].json.endswith('"result":"of null"}')
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_call_depths(spark):
    r = random.Random(3)
    rows, want = [], {}
    for conv in range(6):
        after = {k: [] if k == 0 else [k - 1] if conv < 2 else r.sample(range(k), r.randint(0, min(k, 2))) for k in range(40)}
        if conv == 5:
            after[7] = [30]
            after[30] = [29]
            after[29] = [7]
        depth = {}
        for _ in after:
            for k, a in after.items():
                if k not in depth and all(x in depth for x in a):
                    depth[k] = 1 + max((depth[x] for x in a), default=-1)
        want |= {(str(conv), str(k)): d for k, d in depth.items()}
        rows += [(str(conv), str(k), [str(x) for x in a] + ["none"]) for k, a in after.items()]
    got = tool_calls.depths(spark.createDataFrame(rows, "conv string, call string, after array<string>")).collect()
    assert {(x.conv, x.call): x.depth for x in got} == want and len(got) == len(want)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, db, name):
    df = QUERIES[name](spark, SF)
    cur = db.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(cols, cur.fetchall())


def test_query_personal_data(spark):
    from tests.llm.test_numeric import plain_spans

    got = {r.doc_id: r for r in QUERIES["op1_personal_data"](spark, SF).collect()}
    for i, text in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall():
        base = plain_spans(text)
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))


def test_query_benchmark_matches(spark):
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op2_benchmark_matches"](spark, SF).collect()}
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    for d, text in docs:
        t = decontaminate.normal(text)
        for i, item in items:
            want = decontaminate.myers(decontaminate.normal(item), t, int(decontaminate.RATE * len(decontaminate.normal(item))))
            assert got.get((d, i)) == (want[0] if want else None)


def test_query_token_shards_and_packing(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_token_shards"](spark, SF).collect()}
    tokenizer, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for d, text in docs:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], "<u4")
        assert got[d] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    rows = QUERIES["op8_best_fit_packing"](spark, SF).collect()
    tokenizer, want, total = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), set(), 0
    for d, text in docs:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        head = len(ids) % 2048 or 2048
        for k, a in enumerate([0, *range(head, len(ids), 2048)]):
            b = head if k == 0 else a + 2048
            want.add((d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    assert len({r.sequence_id for r in rows}) <= -(-total // 2048) + 1


def test_query_near_dedup(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()
    got = {r.doc_id: r.class_id for r in QUERIES["op9_minhash_near_dedup"](spark, SF).collect()}
    assert [got[d] for d, _ in docs] == plain_classes(docs)
