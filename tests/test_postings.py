import random

import pytest

from tintlake.operators import catalogue as cg
from tintlake.operators import postings as po

SCHEMA = "pos bigint, id string, name string, description string, categories array<string>, tags array<string>"
WORDS = ["Sunset", "sun", "set", "ÉTÉ", "İzmir", "a\nb", "𝒜𝒷𝒸", "night 🌙🌙", "aaaa", "aab", "%_", "", "x" * 50]


@pytest.fixture(scope="module")
def catalogue(spark):
    r = random.Random(8)
    rows = []
    for pos in range(120):
        text = [None if r.random() < 0.1 else " ".join(r.choices(WORDS, k=r.randint(0, 4))) for _ in range(2)]
        tags = None if pos % 17 == 0 else [r.choice([*WORDS, None]) for _ in range(r.randint(0, 3))]
        rows.append((pos, f"p{pos % 50}", *text, r.choices(["Warm", "Cool", "Big Sky"], k=r.randint(0, 2)), tags))
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def index(catalogue, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index") / "all")
    saved, po.BLOCK = po.BLOCK, 16
    po.write_index(catalogue, folder)
    yield folder
    po.BLOCK = saved


def same(a, b):
    assert a.columns == b.columns
    rows = [sorted(map(repr, df.collect())) for df in (a, b)]
    assert rows[0] == rows[1]
    return len(rows[0])


@pytest.mark.parametrize("text", ["", " SUNset", "set s", "été", "İzm", "a\nb", "𝒷𝒸", "🌙🌙", "aaa", "aa", "%_", "absent", "t  s", "x" * 60])
def test_text_as_the_plain_search(spark, catalogue, index, text):
    same(po.search(spark, index, text=text), cg.search(catalogue, text=text))
    same(po.list_palettes(spark, index, tag=text), cg.list_palettes(catalogue, tag=text))


def test_all_conditions(spark, catalogue, index):
    assert same(po.search(spark, index, "Warm", "sun", "set"), cg.search(catalogue, "Warm", "sun", "set"))
    assert same(po.list_palettes(spark, index, "big sky", "SUN"), cg.list_palettes(catalogue, "big sky", "SUN"))
    with pytest.raises(ValueError, match="unknown category"):
        po.list_palettes(spark, index, "none", "sun")


def test_reads_candidates_only(spark, index):
    """The trigrams reach the scan of the postings, and the palettes are pruned by the partitions of the hits."""
    plan = po.search(spark, index, text="sunset")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan and "dynamicpruning" in plan


def test_empty_catalogue(spark, catalogue, tmp_path):
    folder = str(tmp_path / "none")
    po.write_index(catalogue.filter("pos < 0").withColumn("pos", catalogue.pos), folder)
    assert spark.read.parquet(f"{folder}/postings").count() == 0
