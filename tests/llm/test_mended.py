"""Columns of the input that bear the operators' own names, spans across windows, ids of unusual letters, statistics."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tintlake.llm import decontaminate, minhash, pii, quality, tokens

SF = "/root/testdata/sf0.001"
OWN = ["_id", "_k1", "_k2", "_row", "_text", "_pii", "_matches", "_score", "score", "pii", "matches", "a.b", "a b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    return rows.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id")) for c in OWN})


def kept(df):
    return {r["doc_id"]: tuple(r[c] for c in OWN) for r in df.select("doc_id", *[F.col(f"`{c}`") for c in OWN]).collect()}


def test_operators_keep_every_column(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = kept(docs)
    assert kept(pii.with_personal_data(docs, None)) == want
    assert kept(decontaminate.with_matches(docs, bench)) == want
    assert kept(quality.score(docs, quality.train(docs, labels))) == want
    one = kept(minhash.keep_one(docs))
    assert one == {k: want[k] for k in one} and 0 < len(one) <= len(want)


def test_stages_keep_every_column(spark, docs):
    want = kept(docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = kept(out)
        assert got and all(want[k] == v for k, v in got.items())


def test_bounded_training_rows(spark):
    """One id that holds most rows gives one row to each sample."""
    rows = [(7, f"call +1 (212) 555-{1000 + i} now", 1) for i in range(300)] + [(i, f"mail a{i}@mail.example.com today", i % 2) for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    assert pii.train(docs) is not None
    assert quality.train(docs, docs.select("doc_id", "quality").distinct()).rules is not None


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    r = random.Random(4)
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    letters = "aZ9 İıſKéßΣσǅ่̧̖̀̇҃‍  ½Ⅷ٣京\U0001f600'\n._-"
    texts = ["İ่", "İ̖", "Aİ̖b"] + ["".join(r.choice(letters) for _ in range(r.randint(0, 12))) for _ in range(30_000)]
    got = tokens.encoder(path, name.startswith("word")).encode(texts)
    for text, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == want.ids, ascii(text)


def test_long_spans_at_every_offset():
    """Addresses that the patterns miss, longer than a stride and than a window, at all places in the windows."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeiounrstlm") for _ in range(r.randint(2, 8)))
    words = lambda n: " ".join(word() for _ in range(n))
    texts = [f"{words(14)} {word()}.{word()}{r.randint(1, 99)}@{word()}{r.randint(1, 9)}.example.{r.choice(['com', 'org'])} {words(14)}" for _ in range(600)]
    net = pii.train_tagger(*pii.examples(texts))
    clean = [f"{words(20)} at 10 of {words(8)}" for _ in range(200)]
    assert sum(bool(more) for _, more in pii.find(clean, net)) <= 4
    for address in ("anna.lind7@münchen.example.com", "anna.lind7@mail.münchen.example.com", "anna.lind7@münchen-nord.support.north.office.mail.example.com", "anna.lind7@support.north.students.office.mail.dept-research.münchen-nord.example.com"):
        found = 0
        for shift in range(64):
            left = words(40)[: 100 + shift].rstrip() + " "
            (_, more), = pii.find([left + address + " " + words(20)], net)
            found += any(s <= len(left) + 2 and e >= len(left) + len(address) - 2 for s, _, e in more)
        assert found >= (60 if len(address) < 40 else 30), (address, found)
