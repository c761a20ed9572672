import pytest
from pyspark.sql import functions as F

from tintlake.functions import kernel
from tintlake.functions.parse import with_parsed
from tintlake.operators import contrast, enrich, gradient, harmony

PARSES = {
    "#abcd": (170, 187, 204, 221),
    "0xff8800": (255, 136, 0, 255),
    " #F80 ": (255, 136, 0, 255),
    "ff8800": (255, 136, 0, 255),
    "rgb(255, 0, 0)": (255, 0, 0, 255),
    "RGB(0 0 255 / 50%)": (0, 0, 255, 128),
    "rgb(100% 0% 50%)": (255, 0, 128, 255),
    " rebecca-purple ": (0x66, 0x33, 0x99, 255),
    "Dark_Slate Gray": (0x2F, 0x4F, 0x4F, 255),
    "hsl(120deg 100% 50%)": (0, 255, 0, 255),
    "hsl(0.5turn 100% 50%)": (0, 255, 255, 255),
    "hsl(200grad 100% 50%)": (0, 255, 255, 255),
    "hsv(240 100% 100%)": (0, 0, 255, 255),
    "hls(0 0.5 1.0)": (255, 0, 0, 255),
    "lab(1 0 0)": (255, 255, 255, 255),
    "lab(0 0 0 / 0.5)": (0, 0, 0, 128),
    "oklab(1 0 0)": (255, 255, 255, 255),
    "oklch(0% 0 0)": (0, 0, 0, 255),
}
REFUSED = ["", "#", "#ff", "#fffff", "#abcdefgh", "0xZZZZ", "not-a-color", "hwb(0 0% 0%)", "rgb(1, 2)", "rgb(1 2 3 x)", "rgb(1 2 3 4 5)", "rgb 1 2 3)", "hls(50% 1 1)", None]


def test_parse(spark):
    rows = with_parsed(spark.createDataFrame([(k,) for k in PARSES], "raw string"), "raw").collect()
    assert {r.raw: (r.r, r.g, r.b, r.a) for r in rows} == PARSES
    assert all(r.error is None for r in rows)


def test_refused_rows_stay(spark):
    rows = with_parsed(spark.createDataFrame([(k,) for k in REFUSED], "raw string"), "raw").collect()
    assert len(rows) == len(REFUSED)
    for r in rows:
        assert r.error and r.r is None and r.g is None and r.b is None and r.a is None, r


def test_text_round_trip(spark):
    """Every notation parses back to within one step a channel (whole-number forms are coarser in hue forms)."""
    base = spark.range(400).selectExpr("cast(id*37 % 256 as int) r", "cast(id*101 % 256 as int) g", "cast(id*53 % 256 as int) b", "255 a")
    df = enrich.with_spaces(base)
    for notation, slack in {"hex": 0, "hex-upper": 0, "int": 0, "rgb": 0, "oklab": 1, "hls": 1}.items():
        text = df.select("r", "g", "b", enrich.notation_text(notation).alias("raw")).withColumnsRenamed({c: f"o{c}" for c in "rgb"})
        back = with_parsed(text, "raw")
        worst = back.select(F.max(F.greatest(*[F.abs(F.col(c) - F.col(f"o{c}")) for c in "rgb"])), F.count("error")).first()
        assert worst[0] <= slack and worst[1] == 0, notation


CONTRAST = [
    ("1A1A1A", "FFFFFF", 17.4, 104.27), ("FFFFFF", "1A1A1A", 17.4, -106.55), ("000000", "FFFFFF", 21, 106.04), ("FFFFFF", "000000", 21, -107.88),
    ("6D5AFE", "FFFFFF", 4.62, 71.49), ("6D5AFE", "0F172A", 3.86, -29.07), ("FFA94D", "0F172A", 9.38, -65.4), ("FFD43B", "FFFFFF", 1.43, 20.26),
    ("51CF66", "0F172A", 8.9, -62.75), ("22D3EE", "1A1A1A", 9.63, -68.26), ("777777", "888888", 1.26, 0), ("333333", "3A3A3A", 1.11, 0),
    ("E5E5E5", "FAFAFA", 1.21, 9.9), ("0F172A", "1E293B", 1.22, 0), ("A855F7", "FDE68A", 3.18, 51.69), ("38BDF8", "0F172A", 8.33, -59.51),
]


def rgb(code):
    return tuple(int(code[i : i + 2], 16) for i in (0, 2, 4))


def test_contrast_goldens(spark):
    rows = [(i, *rgb(f), *rgb(b)) for i, (f, b, _, _) in enumerate(CONTRAST)]
    out = contrast.audit(spark.createDataFrame(rows, "pair_id int, fr int, fg int, fb int, br int, bg int, bb int"), "both")
    for r in out.collect():
        _, _, ratio, lc = CONTRAST[r.pair_id]
        assert r.ratio == pytest.approx(ratio, abs=1e-9) and r.lc == pytest.approx(lc, abs=1e-9)
        assert (r.aa, r.aa_large, r.aaa, r.aaa_large) == (ratio >= 4.5, ratio >= 3, ratio >= 7, ratio >= 4.5)


def test_fix_search_finds_a_passing_shade_or_none(spark):
    rows = [(1, *rgb("777777"), *rgb("888888")), (2, *rgb("777777"), *rgb("777777"))]
    pairs = spark.createDataFrame(rows, "pair_id int, fr int, fg int, fb int, br int, bg int, bb int")
    best = contrast.suggest_lightness(pairs, "pair_id").collect()
    assert all(r.score >= 4.5 for r in best)
    none = contrast.suggest_lightness(pairs, "pair_id", target=22.0).collect()
    assert all(r.i is None and r.n_passing == 0 for r in none)
    with pytest.raises(ValueError):
        contrast.lightness_samples(pairs, "pair_id", target=0)


def test_vision_known_values(spark):
    df = spark.createDataFrame([("red", 255, 0, 0), ("lime", 0, 255, 0), ("blue", 0, 0, 255)], "n string, r int, g int, b int")
    got = {(x.n, x.kind): (x.r, x.g, x.b) for x in contrast.simulate_vision(df).collect()}
    for key, want in {("red", "protan"): (144, 142, 0), ("lime", "deutan"): (96, 77, 77), ("blue", "tritan"): (0, 145, 134)}.items():
        assert all(abs(a - b) <= 1 for a, b in zip(got[key], want))


HARMONIES = {
    ("complementary", 0): "6d5afe feea5a",
    ("triadic", 0): "6d5afe fe9b5a 5ffe5a",
    ("split-complementary", 0): "6d5afe fcfe5a fed45a",
    ("tetradic", 0): "6d5afe fe6b5a feea5a 5afeaf",
    ("double-complementary", 0): "6d5afe da5afe feea5a b3fe5a",
    ("compound", 0): "6d5afe 5a9dfe d2fe5a feea5a",
    ("complementary", 8): "6d5afe feea5a 6d62bf bfb362 5b567f 7f7a56 363540 403e35",
    ("analogous", 0): "5a9dfe 6d5afe c35afe",
    ("monochromatic", 0): "6d5afe 7b71cb 777398 616065 282633",
    ("shades", 0): "6d5afe 270bfe 1601b8 0d0168 030019",
}


@pytest.mark.parametrize("case", list(HARMONIES))
def test_harmony_goldens(spark, case):
    base = spark.createDataFrame([(1, *rgb("6D5AFE"))], "base_id int, r int, g int, b int")
    got = [(x.r, x.g, x.b) for x in harmony.generate(base, *case).orderBy("ord").collect()]
    want = [rgb(c) for c in HARMONIES[case].split()]
    assert len(got) == len(want)
    assert all(abs(p - q) <= 1 for a, b in zip(got, want) for p, q in zip(a, b))


def test_harmony_refuses_small_counts(spark):
    base = spark.createDataFrame([(1, 1, 2, 3)], "base_id int, r int, g int, b int")
    with pytest.raises(ValueError):
        harmony.generate(base, "triadic", 2)


def test_wheel_inverse(spark):
    df = spark.range(3600).select((F.col("id") / 10.0).alias("h"))
    back = kernel.ryb_to_rgb_hue(kernel.rgb_to_ryb_hue(F.col("h")))
    assert df.select(F.max(F.abs(back - F.col("h")))).first()[0] < 1e-9


def test_gradient_ends_verbatim_and_monotone(spark):
    ends = spark.createDataFrame([(1, 0, 0, 0, 255, 255, 255)], "k int, ar int, ag int, ab int, br int, bg int, bb int")
    for space in gradient.SPACES:
        rows = gradient.two_stop(ends, "k", 12, space).orderBy("ord").collect()
        assert (rows[0].r, rows[0].g, rows[0].b) == (0, 0, 0) and (rows[-1].r, rows[-1].g, rows[-1].b) == (255, 255, 255)
        assert all(a.r <= b.r for a, b in zip(rows, rows[1:]))


def test_random_palettes_do_not_depend_on_partitions(spark):
    seeds = spark.range(1, 50).withColumnRenamed("id", "seed")
    one = {tuple(r) for r in harmony.random_palettes(seeds.coalesce(1)).collect()}
    many = {tuple(r) for r in harmony.random_palettes(seeds.repartition(7)).collect()}
    assert one == many
