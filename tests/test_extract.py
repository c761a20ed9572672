"""Extraction against plain-Python brute force on small images, and invariants for the seeded methods."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tintlake.functions import kernel
from tintlake.functions.numeric import oklab_of
from tintlake.operators import clusters as cl
from tintlake.operators import pixels as px
from tintlake.operators import quantise as qz
from tintlake.operators import strips as st

import numpy as np


def noise(seed, n, centres):
    rnd = random.Random(seed)
    return [(*[min(255, max(0, c + rnd.randint(-12, 12))) for c in rnd.choice(centres)], 255) for _ in range(n)]


CENTRES = [(220, 40, 50), (30, 90, 200), (215, 200, 60), (40, 150, 90), (128, 128, 128), (20, 20, 30)]
IMAGES = {
    1: (20, noise(1, 400, CENTRES)),
    2: (10, noise(2, 130, CENTRES[:2])),
    3: (4, [(60, 90, 200, 255)] * 16),
    4: (2, [(10, 10, 10, 255), (250, 10, 10, 255), (10, 250, 10, 255), (10, 10, 250, 255)] * 2),
    5: (8, noise(5, 300, [(r, g, 128) for r in (20, 120, 240) for g in (20, 120, 240)])),
}


@pytest.fixture(scope="module")
def pixels(make_pixels):
    return make_pixels(IMAGES).cache()


def palette_of(df):
    out = {}
    for r in df.orderBy("image_id", "ord").collect():
        out.setdefault(r.image_id, []).append((r.r, r.g, r.b, r.n))
    return out


def mean(px_):
    return tuple(sum(p[i] for p in px_) // len(px_) for i in range(3)) + (len(px_),)


def brute_median_cut(points, k):
    buckets = [list(points)]
    while len(buckets) < k:
        big = max(range(len(buckets)), key=lambda i: (len(buckets[i]), -i))
        b = buckets[big]
        if len(b) < 2:
            break
        spans = [max(p[i] for p in b) - min(p[i] for p in b) for i in range(3)]
        axis = spans.index(max(spans))
        b = sorted(b, key=lambda p: (p[axis], *p[:3]))
        buckets[big : big + 1] = [b[: len(b) // 2], b[len(b) // 2 :]]
    return [mean(b) for b in buckets]


def brute_wu(points, k):
    def energy(ps):
        return sum(sum(p[i] for p in ps) ** 2 for i in range(3)) / len(ps)

    def residual(ps):
        return sum(p[i] ** 2 for p in ps for i in range(3)) - energy(ps) if len({tuple(c >> 3 for c in p[:3]) for p in ps}) > 1 else 0

    boxes = [list(points)]
    while len(boxes) < k:
        pick = max(range(len(boxes)), key=lambda i: (residual(boxes[i]), -i))
        if residual(boxes[pick]) <= 0:
            break
        best = None
        for axis in range(3):
            for at in sorted({p[axis] >> 3 for p in boxes[pick]})[:-1]:
                low = [p for p in boxes[pick] if p[axis] >> 3 <= at]
                high = [p for p in boxes[pick] if p[axis] >> 3 > at]
                gain = energy(low) + energy(high)
                if best is None or gain > best[0]:
                    best = (gain, low, high)
        boxes[pick] = best[1]
        boxes.append(best[2])
    return [mean(b) for b in boxes]


def brute_octree(points, k):
    """Level by level over explicit leaves, as sets of pixels keyed by path prefix."""

    def path(p):
        return tuple(((p[0] >> s & 1) << 2) | ((p[1] >> s & 1) << 1) | (p[2] >> s & 1) for s in range(7, -1, -1))

    leaves = {}
    for p in points:
        leaves.setdefault(path(p), []).append(p)
    for depth in range(7, -1, -1):
        groups = {}
        for q in leaves:
            if len(q) > depth:
                groups.setdefault(q[:depth], []).append(q)
        ready = [(sum(len(leaves[q]) for q in qs), node, qs) for node, qs in sorted(groups.items()) if len(qs) > 1]
        for _, node, qs in sorted(ready, key=lambda x: x[0]):
            if len(leaves) > k and len(qs) - 1 <= len(leaves) - k:
                leaves[node] = [p for q in sorted(qs) for p in leaves.pop(q)]
    rows = [leaves[q] for q in sorted(leaves)]
    while len(rows) > k:
        lab = oklab_of(np.array([mean(r)[:3] for r in rows]))
        d = {(i, j): ((lab[i] - lab[j]) ** 2).sum() for i in range(len(rows)) for j in range(i + 1, len(rows))}
        i, j = min(d, key=lambda x: (d[x], x))
        rows[i] += rows.pop(j)
    return [mean(r) for r in rows]


@pytest.mark.parametrize("k", [1, 3, 5, 9])
def test_median_cut(pixels, k):
    got = palette_of(qz.median_cut(pixels, k))
    assert got == {i: brute_median_cut(p, k) for i, (_, p) in IMAGES.items()}


@pytest.mark.parametrize("k", [1, 4, 6])
def test_wu(pixels, k):
    got = palette_of(qz.wu(pixels, k))
    assert got == {i: brute_wu(p, k) for i, (_, p) in IMAGES.items()}


@pytest.mark.parametrize("k", [1, 2, 5, 7, 12])
def test_octree(pixels, k):
    got = palette_of(qz.octree(pixels, k))
    assert got == {i: brute_octree(p, k) for i, (_, p) in IMAGES.items()}


def test_popularity(pixels):
    got = palette_of(qz.popularity(pixels, 3))
    for i, (_, p) in IMAGES.items():
        bins = {}
        for q in p:
            bins.setdefault((q[0] >> 3, q[1] >> 3, q[2] >> 3), []).append(q)
        top = sorted(bins.items(), key=lambda kv: (-len(kv[1]), kv[0]))[:3]
        assert got[i] == [mean(v) for _, v in top]


METHODS = {
    "kmeans": lambda p, k: cl.kmeans(p, k, rounds=10),
    "okkmeans": lambda p, k: cl.kmeans(p, k, "oklab", rounds=10),
    "wkmeans": lambda p, k: cl.weighted_kmeans(p, k, clusters=8, rounds=5),
    "soft": lambda p, k: cl.soft(p, k, clusters=8, rounds=5),
    "softk": lambda p, k: cl.soft(p, k, count_stop=True, clusters=8, rounds=5),
    "dbscan": cl.dbscan,
}


@pytest.mark.parametrize("method", list(METHODS))
def test_seeded_methods(pixels, method):
    """At least one colour per image, size respected, shares sum to one, same result twice, blue stays blue."""
    run = lambda: METHODS[method](pixels, 4)
    rows = run().collect()
    share = Counter()
    for r in rows:
        share[r.image_id] += r.freq
    assert set(share) == set(IMAGES)
    assert all(abs(v - 1) < 1e-9 for v in share.values())
    assert max(r.ord for r in rows) < 4
    blue = [r for r in rows if r.image_id == 3]
    assert all(abs(r.r - 60) <= 1 and abs(r.g - 90) <= 1 and abs(r.b - 200) <= 1 for r in blue)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run().collect()))


def test_kmeans_beats_one_centre(pixels):
    points = cl.color_points(pixels.filter("image_id = 1"), "oklab")
    labelled = cl.cluster_points(points, 6, 10)
    spread = lambda df: df.agg(*[F.sum(F.col("w") * F.col(f) * F.col(f)) - F.pow(F.sum(F.col("w") * F.col(f)), 2) / F.sum("w") for f in cl.FEATURES])
    before = sum(spread(points).first())
    parts = labelled.groupBy("c").agg(*[F.sum(F.col("w") * F.col(f) * F.col(f)) - F.pow(F.sum(F.col("w") * F.col(f)), 2) / F.sum("w") for f in cl.FEATURES])
    after = sum(sum(r[1:]) for r in parts.collect())
    assert after < before * 0.1


def test_soft_falls_back_when_nothing_matches(make_pixels):
    grey = make_pixels({1: (4, [(128, 128, 128, 255)] * 16)})
    rows = cl.soft(grey, 3, clusters=4, rounds=3).collect()
    assert rows and all(r.fell_back for r in rows)


def test_merge_stops_by_distance_and_count(spark):
    rows = [(1, c, float(v), 0.0, 0.0, 1.0, 0.0) for c, v in enumerate((0, 1, 10, 11, 30))]
    df = spark.createDataFrame(rows, "image_id bigint, c bigint, f0 double, f1 double, f2 double, n double, s double")
    assert sorted(r.f0 for r in cl.merge_clusters(df, 2.0, 1).collect()) == [0.5, 10.5, 30.0]
    assert cl.merge_clusters(df, float("inf"), 2).count() == 2
    assert cl.merge_clusters(df, 100.0, 4).count() == 4


def test_subsample_strides_over_valid_rows(make_pixels, monkeypatch):
    from tintlake import runtime

    monkeypatch.setattr(runtime, "TILE_ROWS", 7)  # force several tiles
    rows = [(i % 256, 0, 0, 0 if i % 3 == 0 else 255) for i in range(100)]
    df = px.opaque(make_pixels({1: (10, rows), 2: (2, rows[:6])}))
    got = {(r.image_id, r.idx) for r in px.subsample(df, 20).collect()}
    valid = [i for i, r in enumerate(rows) if r[3]]
    want = {(1, valid[j]) for j in range(0, len(valid), len(valid) // 20)[:20]} | {(2, i) for i in range(6) if rows[i][3]}
    assert got == want


def test_annotate_first_pixel_on_ties(make_pixels, spark):
    df = make_pixels({1: (3, [(9, 9, 9, 255), (10, 0, 0, 255), (10, 0, 0, 255), (0, 0, 0, 0)])})
    pal = spark.createDataFrame([(1, 0, 10, 0, 0), (1, 1, 0, 0, 0)], "image_id bigint, ord int, r int, g int, b int")
    images = spark.createDataFrame([(1, 3, 2)], "image_id bigint, w int, h int")
    got = {r.ord: (r.src_x, r.src_y) for r in qz.annotate(pal, df, images).collect()}
    assert got == {0: (1.5 / 3, 0.5 / 2), 1: (0.5 / 3, 1.5 / 2)}


def test_batch_all_failed(make_pixels, spark):
    clear = make_pixels({1: (1, [(1, 2, 3, 0)])})
    rows = qz.batch(clear, spark.createDataFrame([(1,), (2,)], "image_id bigint"), qz.popularity(px.opaque(clear)))
    assert {r.image_id: r.error for r in rows.collect()} == {1: "no pixels left after alpha mask", 2: "source not readable"}
    with pytest.raises(ValueError):
        qz.require_success(rows)


@pytest.mark.parametrize("width", [3, 32, 500])
def test_strips_brute_force(make_pixels, spark, monkeypatch, width):
    """Few colours, so columns cut through ties of several colours; small tiles, so ranks cross tiles."""
    from tintlake import runtime

    monkeypatch.setattr(runtime, "TILE_ROWS", 11)
    rnd = random.Random(4)
    pool = [(r, g, b, 255) for r in (0, 200) for g in (0, 200) for b in (0, 128)]
    pics = {1: (9, [rnd.choice(pool) for _ in range(97)]), 2: (5, [(7, 7, 200, 255)] * 40), 3: (3, [rnd.choice(pool) for _ in range(5)])}
    got = {(r.image_id, r.metric, r.col): (r.r, r.g, r.b) for r in st.strips(make_pixels(pics), width).collect()}
    want = {}
    for i, (_, p) in pics.items():
        arr = np.array([q[:3] for q in p])
        lab = oklab_of(arr)
        keys = {
            "luminance": np.floor(lab[:, 0] * 1e6 + 0.5),
            "saturation": np.floor(np.hypot(lab[:, 1], lab[:, 2]) * 1e6 + 0.5),
            "distance": ((arr - np.array([0, 0, 255])) ** 2).sum(axis=1),
        }
        for metric, key in keys.items():
            order, n = np.argsort(key, kind="stable"), len(p)
            for x in range(width):
                part = order[x * n // width : (x + 1) * n // width]
                if len(part):
                    want[i, metric, x] = lab[part].mean(axis=0)
    assert {k for k in got if k[1] != "hue"} == set(want)
    back = spark.createDataFrame([(k[0], k[1], k[2], *map(float, v)) for k, v in want.items()], "i bigint, m string, c bigint, L double, A double, B double")
    from tintlake.functions import kernel

    for r in kernel.with_oklab_bytes(back, F.col("L"), F.col("A"), F.col("B")).collect():
        assert all(abs(p - q) <= 1 for p, q in zip(got[r.i, r.m, r.c], (r.r, r.g, r.b)))


def test_strip_fill(spark):
    strip = spark.createDataFrame([(1, "hue", 2, 9, 9, 9), (1, "hue", 4, 5, 5, 5)], "image_id bigint, metric string, col bigint, r int, g int, b int")
    got = [r.r for r in st.fill_columns(strip, 6).orderBy("col").collect()]
    assert got == [0, 0, 9, 9, 5, 5]


def plain_lloyd(points, k, rounds):
    """Labels of weighted points {pos: (w, x)} by the same seeds and rounds in plain Python."""
    near = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    order = lambda pos, mass: (math.floor(math.log(mass + 1) * 1e6), -pos)
    first = max(points, key=lambda p: order(p, points[p][0]))
    centres = [points[first][1]]
    while len(centres) < k:
        far = {p: w * min(near(x, c) for c in centres) for p, (w, x) in points.items()}
        best = max((p for p in far if far[p] > 0), key=lambda p: order(p, far[p]), default=None)
        if best is None:
            break
        centres.append(points[best][1])
    label = lambda x: min(range(len(centres)), key=lambda c: (near(x, centres[c]), c))
    for _ in range(rounds):
        groups = {}
        for w, x in points.values():
            groups.setdefault(label(x), []).append((w, x))
        centres = [
            tuple(round(sum(w * x[q] for w, x in groups[c]) / sum(w for w, _ in groups[c]), 6) for q in range(3)) if c in groups else points[first][1]
            for c in range(len(centres))
        ]
    return {p: label(x) for p, (w, x) in points.items()}


@pytest.mark.parametrize("small", [True, False])
def test_lloyd_rounds(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(cl, "BROADCAST_BYTES", 0)
    r = random.Random(5)
    keys = {1: 60, 2: 3, 3: 1, 4: 25}
    points = {key: {p: (r.randint(1, 50), tuple(round(r.random() * 100, 6) for _ in range(3))) for p in r.sample(range(1 << 24), n)} for key, n in keys.items()}
    rows = [(key, p, w, *x) for key, part in points.items() for p, (w, x) in part.items()]
    df = spark.createDataFrame(rows, "image_id bigint, pos bigint, w bigint, f0 double, f1 double, f2 double")
    got = {(x.image_id, x.pos): x.c for x in cl.cluster_points(df, 4, 6).collect()}
    assert got == {(key, p): c for key, part in points.items() for p, c in plain_lloyd(part, 4, 6).items()}


def test_every_pixel_of_a_large_image_counts(spark):
    df = spark.range(40_000).selectExpr("1L as image_id", "cast(id % 251 as int) as r", "cast(id % 241 as int) as g", "cast(id % 239 as int) as b")
    assert cl.kmeans(df, 3, rounds=2).agg(F.sum("n")).first()[0] == 40_000


def test_extraction_job(pixels, spark):
    from tintlake.operators import extract as ex

    images = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    palette, record = ex.extract(pixels, images, "popularity", k=4, resize=5, sort_by="luminance", located=True)
    rows = palette.collect()
    assert {r.image_id for r in rows} == {r.image_id for r in record.collect()}
    assert all(r.params == {"palette_size": "4", "resize": "5", "sort_by": "luminance"} for r in record.collect())
    for i in {r.image_id for r in rows}:
        own = sorted((r for r in rows if r.image_id == i), key=lambda r: r.ord)
        assert [r.ord for r in own] == list(range(len(own))) and len(own) <= 4 and all(0 < r.src_x < 1 and 0 < r.src_y < 1 for r in own)
    for bad in ({"method": "none"}, {"method": "wu", "preset": "muted"}, {"method": "wu", "k": 0}):
        with pytest.raises(ValueError):
            ex.extract(pixels, images, **bad)
    both, records = ex.extract_jobs(pixels, images, [{"method": "popularity", "k": 2}, {"method": "wu", "k": 3}])
    assert {r.job for r in both.collect()} == {0, 1} and records.count() == 2 * record.count()


def test_strips_of_a_white_image(spark, make_pixels, monkeypatch):
    """Nine tenths white, with greys and tied colours around it, against sorted pixels; tiles smaller than columns."""
    r = random.Random(12)
    white, tied = (255, 255, 255), [(255, 0, 10), (255, 10, 0), (10, 255, 0), (0, 255, 10), (254, 254, 254)]
    colours = [white if r.random() < 0.9 else r.choice(tied) for _ in range(3000)]
    table = make_pixels({1: (50, [(*c, 255) for c in colours]), 2: (10, [(*white, 255)] * 40)})
    want = None
    for size in (1 << 10, 8, 1):
        monkeypatch.setattr(st, "TIE_TILE", size)
        got = {(x.image_id, x.metric, x.col): (x.r, x.g, x.b) for x in st.strips(table, 7).collect()}
        want = want or got
        assert got == want
    lab = {(x.r, x.g, x.b): x for x in st.metric_keys(kernel.with_oklch(table.filter("image_id = 1").select("r", "g", "b").distinct())).filter("metric = 'distance'").collect()}
    order = sorted(range(3000), key=lambda i: (lab[colours[i]].key, i))
    for col in range(7):
        part = [lab[colours[i]] for i in order[-(-col * 3000 // 7) : -(-(col + 1) * 3000 // 7)]]
        mean = [sum(getattr(x, c) for x in part) / len(part) for c in ("ok_l", "ok_a", "ok_b")]
        one = spark.createDataFrame([tuple(mean)], "ok_l double, ok_a double, ok_b double")
        bytes_ = kernel.with_oklab_bytes(one, F.col("ok_l"), F.col("ok_a"), F.col("ok_b")).first()
        assert all(abs(a - b) <= 1 for a, b in zip((bytes_.r, bytes_.g, bytes_.b), want[1, "distance", col]))


def test_keys_of_greys_are_those_of_the_sql(spark):
    """The hue of a grey is rounding noise that straddled a key (136 and 130 in one, not in the other)."""
    import duckdb

    from tintlake.plans import oracle as o

    greys = spark.range(256).selectExpr("cast(id as int) r", "cast(id as int) g", "cast(id as int) b")
    got = {x.r: x.key for x in st.metric_keys(kernel.with_oklch(greys)).filter("metric = 'hue'").collect()}
    src = "(select range::int as r, range::int as g, range::int as b from range(256))"
    assert got == dict(duckdb.sql(f"select r, {o.micro('ok_h')} from {o.oklab(src)}").fetchall())


@pytest.mark.parametrize("space", ["oklch", "hsl"])
def test_strips_of_small_and_large_images_agree(spark, make_pixels, monkeypatch, space):
    r = random.Random(9)
    pool = [(v, v, v, 255) for v in (3, 130, 136, 145)] + [(r.randrange(0, 256, 60), r.randrange(0, 256, 60), r.randrange(0, 256, 60), 255) for _ in range(12)]
    pics = {i: (7, [r.choice(pool) for _ in range(n)]) for i, n in ((1, 5), (2, 90), (3, 400))}
    table, got = make_pixels(pics), []
    for limit in (1 << 16, 64, 7):
        monkeypatch.setattr(st, "SMALL_IMAGE", limit)
        got.append({tuple(x) for x in st.strips(table, 13, space).collect()})
    assert got[0] == got[1] == got[2]
    lone = st._small_columns(table.limit(0).selectExpr("image_id", "r", "g", "b", "1L n", "1L n_valid", "array(0) at"), 13, space, "blue")
    assert "BroadcastHashJoin" not in lone._jdf.queryExecution().executedPlan().toString()  # no fact is repeated for a join


def test_density_labels_of_small_and_large_images_agree(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, k, r.randint(1, 3), *(r.choice((5.0, 40.0, 70.0)) + r.gauss(0, 4) for _ in range(3))) for i, n in ((1, 1), (2, 60), (3, 300)) for k in r.sample(range(1 << 15), n)]
    bins = spark.createDataFrame(rows, "image_id bigint, key int, n bigint, f0 double, f1 double, f2 double")
    got = []
    for limit in (1 << 11, 100, 0):
        monkeypatch.setattr(cl, "SMALL_BINS", limit)
        got.append({tuple(x) for x in cl.label_density(bins).collect()})
    assert got[0] == got[1] == got[2] and len(got[0]) == 361 and max(x[-1] for x in got[0]) > 3


def test_strip_fill_makes_columns_from_their_left_neighbours(spark):
    """No frame of all columns is shuffled; odd rows as by a frame joined to the strip."""
    schema = "image_id bigint, metric string, col bigint, r int, g int, b int"
    rows = [(1, "hue", 2, 9, 8, 7), (1, "hue", 4, 5, None, 5), (1, "luminance", 0, 1, 1, 1), (2, "hue", 5, 3, 3, 3), (2, "hue", 2, 4, 4, 4), (2, "hue", 2, 4, 4, 4)]
    rows += [(3, "hue", None, 6, 6, 6), (3, "hue", 9, 6, 6, 6), (4, "hue", -1, 6, 6, 6), (4, "hue", 3, 2, 2, 2), (None, "hue", 1, 6, 6, 6), (5, None, 1, 6, 6, 6)]
    strip = spark.createDataFrame(rows, schema)
    filled = st.fill_columns(strip, 6)
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    got = sorted((tuple(r) for r in filled.collect()), key=repr)
    want = []
    for image, metric in {x[:2] for x in rows}:
        last = [0, 0, 0]
        for col in range(6):
            here = [x[3:] for x in rows if x[:3] == (image, metric, col) and None not in (image, metric)]
            for rgb in here or [last]:
                last = [last[i] if v is None else v for i, v in enumerate(rgb)]
                want.append((image, metric, col, *last))
    assert got == sorted(want, key=repr)


def test_small_images_are_spread_by_their_number(spark, make_pixels, monkeypatch):
    rnd = random.Random(9)
    pics = {i: (7, [(rnd.randrange(256), rnd.randrange(256), 0, 255) for _ in range(60)]) for i in range(20)}
    want = sorted(tuple(r) for r in st.strips(make_pixels(pics), 16).collect())
    monkeypatch.setattr(st, "TASK_COLORS", 30)
    parts = []
    monkeypatch.setattr(st, "_small_columns", lambda *a, f=st._small_columns: (parts.append(a[-1]), f(*a))[1])
    assert sorted(tuple(r) for r in st.strips(make_pixels(pics), 16).collect()) == want
    assert parts[0] >= 20 * 60 // 30 - 2


def test_pixels_without_red_count_alike_beside_large_images(spark, make_pixels, monkeypatch):
    monkeypatch.setattr(st, "SMALL_IMAGE", 64)
    small = make_pixels({1: (7, [(5 * i % 256, 9 * i % 256, 3, 255) for i in range(60)])}).withColumn("r", F.when(F.col("idx") % 7 > 0, F.col("r")))
    large = make_pixels({2: (7, [(5 * i % 256, 9 * i % 256, 3, 255) for i in range(200)])})
    alone = sorted(tuple(r) for r in st.strips(small, 16).collect())
    assert alone == sorted(tuple(r) for r in st.strips(small.unionByName(large), 16).filter("image_id = 1").collect())
    assert len(alone) > 40
