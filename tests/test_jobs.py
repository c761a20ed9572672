import numpy as np
import pytest
from pyspark.sql import functions as F

from tintlake.functions import constants as K
from tintlake.operators import clusters as cl
from tintlake.operators import extract as ex
from tintlake.operators import jobs as jb


@pytest.fixture(scope="module")
def pixels(spark, make_pixels):
    rng = np.random.default_rng(5)
    images = {}
    for i in range(3):
        spots = rng.integers(0, 256, (9, 3))
        rows = np.clip(spots[rng.integers(0, 9, 240)] + rng.integers(-9, 10, (240, 3)), 0, 255)
        images[i] = (20, [(*map(int, p), 255 if j % 11 else 0) for j, p in enumerate(rows)])
    return make_pixels(images).cache()


KNOBS = [
    {"method": "soft", "k": 4, "preset": " Muted"},
    {"method": "soft", "k": 6, "min_l": 0.4, "prefer_l": 0.5},
    {"method": "softk", "k": 3, "preset": "dark", "exponent": 2.0},
    {"method": "soft", "preset": "bright", "min_c": 0.3, "merge_distance": 30.0},
    {"method": "softk"},
    *[{"method": m, "k": k} for m in ex.METHODS if m not in ex.PRESET_METHODS for k in ((2, 5) if m in ("popularity", "kmeans") else (3,))],
]


def test_a_table_of_jobs_equals_single_extractions(spark, pixels):
    rows = [{"job": 10 * n + i, "image_id": i, **knobs} for n, knobs in enumerate(KNOBS) for i in range(3)]
    rows += [{**row, "job": row["job"] + 1000} for row in rows]
    names = ["job", "image_id", *jb.PARAMETERS]
    kinds = {"job": "bigint", "image_id": "bigint", "method": "string", "k": "int", "preset": "string"}
    schema = ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names)
    jobs = spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)
    palettes, records = jb.run_jobs(pixels, jobs)
    got = {}
    for r in palettes.orderBy("job", "ord").collect():
        got.setdefault(r.job, []).append((r.ord, r.r, r.g, r.b, r.n, round(r.freq, 9), r.fell_back))
    assert records.filter("error is not null").count() == 0
    work = pixels.filter("a > 0")
    for n, knobs in enumerate(KNOBS):
        rest = {k: v for k, v in knobs.items() if k not in ("method", "k")}
        single = ex.METHODS[knobs["method"]](work, knobs.get("k", K.PALETTE_SIZE), **rest)
        want = {}
        for r in single.orderBy("image_id", "ord").collect():
            row = r.asDict()
            want.setdefault(r.image_id, []).append((r.ord, r.r, r.g, r.b, r.n, round(r.freq, 9), row.get("fell_back")))
        for i in range(3):
            assert got[10 * n + i] == want[i] == got[10 * n + i + 1000], (knobs, i)


def test_jobs_that_cannot_run_keep_their_record(spark, pixels):
    rows = [(1, 0, "popularity", 5, None), (2, 0, "magic", 5, None), (3, 0, "wu", 99, None), (4, 0, "wu", 5, "dark"), (5, 0, "soft", 5, "gloomy"), (6, 77, "wu", 5, None), (7, 0, None, 5, None), (8, None, "wu", 5, None)]
    jobs = spark.createDataFrame(rows, "job bigint, image_id bigint, method string, k int, preset string")
    palettes, records = jb.run_jobs(pixels, jobs)
    assert {r.job for r in palettes.collect()} == {1}
    errors = {r.job: r.error for r in records.collect()}
    assert errors == {1: None, 2: "unknown method magic", 3: "a palette has 1 to 32 colours, not 99", 4: "wu takes no preset", 5: "unknown preset gloomy", 6: "no pixels", 7: "unknown method null", 8: "no pixels"}
    palettes, records = jb.run_jobs(pixels, jobs.filter("job > 1"))
    assert palettes.count() == 0 and records.count() == 7
    palettes, records = jb.run_jobs(pixels, jobs.limit(0))
    assert palettes.count() == 0 and records.count() == 0


def test_plan_size_does_not_follow_the_number_of_jobs(spark, pixels):
    def plan(n):
        jobs = spark.range(n).selectExpr("id job", "id % 3 image_id", "'popularity' method", "cast(1 + id % 32 as int) k")
        palettes, _ = jb.run_jobs(pixels, jobs)
        assert palettes.select("job").distinct().count() == n
        return str(palettes._jdf.queryExecution().optimizedPlan()).count("Join")

    assert plan(3) == plan(10_000)


def test_clusters_of_different_numbers_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.integers(0, 40, 3)), float(rng.integers(1, 5)), p, 2 + 3 * i) for i in range(3) for p in range(300)]
    df = spark.createDataFrame(rows, "image_id bigint, f0 double, f1 double, f2 double, w double, pos bigint, many int")
    one = {(r.image_id, r.pos): r.c for r in cl.cluster_points(df, "many").collect()}
    for i in range(3):
        alone = cl.cluster_points(df.filter(F.col("image_id") == i), 2 + 3 * i)
        assert {(r.image_id, r.pos): r.c for r in alone.collect()} == {k: c for k, c in one.items() if k[0] == i}
    monkeypatch.setattr(cl, "BLOCK_POINTS", 64)
    assert {(r.image_id, r.pos): r.c for r in cl.cluster_points(df, "many").collect()} == one
