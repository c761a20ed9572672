import collections
import random

import pytest

from tintlake.operators import pixels as px
from tintlake.operators import sketches as sk

SCHEMA = "image_id bigint, part int, r int, g int, b int"


def table(spark, n, seed=1):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        heavy = r.random() < 0.5
        colour = r.choice([(250, 10, 10), (10, 250, 10), (3, 3, 200)]) if heavy else tuple(r.randint(0, 255) for _ in range(3))
        rows.append((r.choice([1, 1, 1, 2]), r.randint(0, 5), *colour))
    return spark.createDataFrame(rows, SCHEMA)


def exact(pixels, group):
    return {(row[group], row.key): row.n for row in px.bin_sums(pixels, 5, (group,)).collect()}


@pytest.mark.parametrize("tracked", [16, 64, 1024])
def test_error_bound_after_merging(spark, tracked):
    pixels = table(spark, 20_000)
    parts = sk.sketch_colors(pixels, ["image_id", "part"], tracked)
    for group in ("image_id", "part"):
        counts, found = exact(pixels, group), collections.Counter()
        for row in sk.heavy_colors(sk.merge_sketches(parts, [group], tracked), [group], 8, tracked).collect():
            assert abs(row.estimate - counts[row[group], row.key]) <= row.error
            assert row.n == sum(n for (g, _), n in counts.items() if g == row[group])
            assert (row.r >> 3 << 10) + (row.g >> 3 << 5) + (row.b >> 3) == row.key
            found[row[group]] += 1
        # each of the three common colours has a sixth of all pixels
        assert all(found[g] >= 3 for g, _ in counts) or tracked == 16


def test_small_input_is_exact(spark):
    pixels = table(spark, 300)
    got = sk.heavy_colors(sk.merge_sketches(sk.sketch_colors(pixels, ["image_id", "part"]), ["image_id"]), ["image_id"], 1000)
    assert {(r.image_id, r.key): r.estimate for r in got.collect()} == exact(pixels, "image_id")


def test_nulls_and_empty(spark):
    pixels = spark.createDataFrame([(1, 0, None, 2, 3), (1, 0, 1, 2, 3), (None, 0, 1, 2, 3)], SCHEMA)
    got = sk.heavy_colors(sk.sketch_colors(pixels, ["image_id"]), ["image_id"], 3)
    assert sorted((str(r.image_id), r.estimate, r.n) for r in got.collect()) == [("1", 1, 1), ("None", 1, 1)]
    assert sk.heavy_colors(sk.sketch_colors(pixels.limit(0), ["image_id"]), ["image_id"], 3).count() == 0
