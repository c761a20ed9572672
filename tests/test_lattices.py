"""Lattice generation for large palettes: nearest colours against all pairs, hue anchors against one plain fold."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tintlake.functions import kernel
from tintlake.operators import lut


def table(spark, palettes):
    rows = [(p, i, *c) for p, colours in palettes.items() for i, c in enumerate(colours)]
    return spark.createDataFrame(rows, "palette_id bigint, ord int, r int, g int, b int")


def clustered(r, n):
    """Colours around one hue (with repeats) and a few far away."""
    near = [tuple(min(255, max(0, int(r.gauss(m, 12)))) for m in (200, 60, 40)) for _ in range(n)]
    return near + near[: n // 5] + [(0, 0, 255), (0, 0, 255), (255, 255, 255), (0, 0, 0)]


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_colours_match_all_pairs(spark, k):
    r = random.Random(k)
    cube = [(x, y, z) for x in range(0, 256, 51) for y in range(0, 256, 51) for z in range(0, 256, 51)]
    palettes = table(spark, {1: clustered(r, 250), 2: [(10, 200, 30)], 3: [(9, 9, 9)] * 7, 4: cube, 5: [tuple(r.randrange(256) for _ in range(3)) for _ in range(60)]})
    rank = F.row_number().over(Window.partitionBy("palette_id", "node").orderBy("d", "ord"))

    def nearest(df):
        return {tuple(x) for x in df.withColumn("rank", rank).filter(F.col("rank") <= k).select("palette_id", "size", "node", "rank", "ord", "d").collect()}

    pruned = lut._near_colours_at_nodes(palettes, 7, (), k).persist()
    every = lut._colours_at_nodes(palettes, 7, ())
    assert nearest(pruned) == nearest(every)
    of = lambda df: df.filter("palette_id = 4").count()
    assert of(pruned) < of(every) / 3  # most pairs are never made


def test_jobs_of_many_sizes(spark):
    """Sizes as a column: even and odd lattices, and one smaller than its number of blocks."""
    r = random.Random(8)
    palettes = table(spark, {s: clustered(r, 30) for s in (2, 3, 10, 19)}).withColumn("s", F.col("palette_id").cast("int"))
    got = lut.knn_lattice(palettes, size=F.col("s"), carry=("s",))
    assert {x.palette_id: x["count"] for x in got.groupBy("palette_id").count().collect()} == {s: s**3 for s in (2, 3, 10, 19)}
    one = lut.knn_lattice(palettes.filter("palette_id = 10"), size=10)
    want = {tuple(x) for x in one.collect()}
    assert {tuple(x) for x in got.filter("palette_id = 10").collect()} == want


def plain_anchors(hues):
    out = []
    for h, c in hues:
        if out and h - out[-1][0] < lut.MERGE_DEGREES:
            out[-1] = ((out[-1][0] + h) / 2.0, (out[-1][1] + c) / 2.0)
        else:
            out.append((h, c))
    return out


def test_anchors_match_one_fold(spark):
    r = random.Random(6)
    grey = [(v, v, v) for v in range(0, 256, 40)]
    palettes = table(spark, {1: [tuple(r.randrange(256) for _ in range(3)) for _ in range(900)], 2: clustered(r, 80), 3: grey, 4: [(255, 0, 0)], 5: [(255, 0, 0), (0, 255, 0), (0, 0, 255)] * 3})
    raw = kernel.with_oklch(palettes).filter(F.col("ok_c") >= lut.NEUTRAL_CHROMA).select("palette_id", "ok_h", "ord", "ok_c").collect()
    want = {p: plain_anchors([(x.ok_h, x.ok_c) for x in sorted(raw, key=lambda x: (x.ok_h, x.ord)) if x.palette_id == p]) for p in (1, 2, 4, 5)}
    got = {}
    for x in lut.hue_anchors(palettes).collect():
        got.setdefault(x.palette_id, []).append((x.h, x.c))
    assert {p: sorted(v) for p, v in got.items()} == want
    wheels = {x.palette_id: x for x in lut.hue_wheels(palettes).collect()}
    assert wheels[3].m == 0 and wheels[3].an == [] and wheels[1].m == len(want[1]) <= 180
    assert all(list(w.below) == [sum(a.h < d for a in w.an) for d in range(361)] for w in wheels.values())
    assert lut.grade_lattice(palettes, 5).groupBy("palette_id").count().filter("count = 125").count() == 5


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeated_rows_are_never_broadcast(spark, tmp_path):
    """A small file becomes many nodes: no join may be planned by the size of the file."""
    table(spark, {p: clustered(random.Random(p), 6) for p in range(20)}).write.parquet(str(tmp_path / "p"))
    palettes = spark.read.parquet(str(tmp_path / "p"))
    assert "BroadcastHashJoin" not in plan_of(lut.hue_wheels(palettes))
    assert "BroadcastHashJoin" not in plan_of(lut._by_size(palettes)[0])
    pixels = palettes.selectExpr("palette_id image_id", "cast(ord as bigint) idx", "r", "g", "b")
    assigned = pixels.groupBy("image_id").agg(F.count("*").alias("n_total")).withColumn("palette_id", F.col("image_id"))
    lattice = lut.knn_lattice(palettes, 5)
    graded = lut.apply_lattice(pixels, assigned, lattice)
    joins = [x for x in plan_of(graded).splitlines() if "BroadcastHashJoin" in x]
    assert not any("node" in x or "r#" in x for x in joins)


@pytest.mark.parametrize("make", [lut.knn_lattice, lut.rbf_lattice])
def test_small_and_large_palettes_give_the_same_lattice(spark, monkeypatch, make):
    r = random.Random(3)
    palettes = table(spark, {1: clustered(r, 30), 2: [(9, 9, 9)] * 7, 3: [(10, 200, 30)], 4: clustered(r, 90)})
    got = []
    for limit in (0, 40, 1 << 20):
        monkeypatch.setattr(lut, "SMALL_PALETTE", limit)
        got.append({tuple(x) for x in make(palettes, 6).collect()})
    assert got[0] == got[1] == got[2] and len(got[0]) == 4 * 216


def test_equal_colours_weigh_as_often_as_they_occur(spark):
    once = table(spark, {1: [(250, 0, 0), (0, 0, 250)]})
    often = table(spark, {1: [(250, 0, 0)] * 50 + [(0, 0, 250)]})
    red = lambda df: sum(x.r for x in lut.rbf_lattice(df, 5).collect())
    assert red(often) > red(once)
