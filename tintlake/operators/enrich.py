"""Colour-table projections: standardising, naming, enriching, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import kernel
from ..functions.parse import with_parsed

NEAR_EXACT = 0.5  # CIE76 distance under which a named colour counts as equal


def standardise(strings: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse mixed-notation colour text in place; rows keep their identity, failures carry ``error``."""
    return with_parsed(strings, raw)


def split_bad(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.filter(F.col("error").isNull()), parsed.filter(F.col("error").isNotNull())


def notation_profile(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("notation").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("n_bad"))


def named_dim(spark: SparkSession) -> DataFrame:
    """The 148 fixed names with their channels."""
    body = ",".join(f"('{name}', {int(c[0:2], 16)}, {int(c[2:4], 16)}, {int(c[4:6], 16)})" for name, c in K.NAMED)
    return spark.sql(f"select * from values {body} as t(name, r, g, b)")


def name_lookup(strings: DataFrame, raw: str) -> DataFrame:
    """Inner join to the named colours on the normalised key; the dimension is a fixed 148 rows."""
    key = F.regexp_replace(F.lower(F.trim(F.col(raw))), "[-_ ]", "")
    dim = F.broadcast(named_dim(strings.sparkSession))
    return strings.withColumn("name", key).join(dim, "name")


def _canonical_names() -> list[tuple[str, tuple[int, int, int]]]:
    """One name per distinct colour, alphabetically first."""
    first: dict[str, str] = {}
    for name, code in sorted(K.NAMED):
        first.setdefault(code, name)
    return sorted((name, tuple(int(code[i : i + 2], 16) for i in (0, 2, 4))) for code, name in first.items())


def lab_of(rgb: tuple[int, int, int]) -> tuple[float, float, float]:
    """CIE Lab of one fixed colour (CSS scale), for building constant tables."""
    lin = [kernel._linear(c) for c in rgb]
    f = []
    for row, white in zip(K.RGB_TO_XYZ, K.D65):
        t = sum(w * v for w, v in zip(row, lin)) / white
        f.append(t ** (1 / 3) if t > (6 / 29) ** 3 else t / 3 * (29 / 6) ** 2 + 4 / 29)
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def _named_lab_array() -> Column:
    rows = []
    for name, rgb in _canonical_names():
        L, a, b = lab_of(rgb)
        code = "#%02x%02x%02x" % rgb
        rows.append(f"named_struct('l',{L!r}D,'a',{a!r}D,'b',{b!r}D,'name','{name}','hex','{code}')")
    return F.expr("array(" + ",".join(rows) + ")")


def nearest_names(colors: DataFrame) -> DataFrame:
    """Add ``name``, ``name_hex``, ``distance``, ``label`` of the closest named colour.

    Every row is compared with a constant array of names in place: no join, so no colour can be a hot key.
    """
    placed = kernel.with_lab(colors)

    def scored(x: Column) -> Column:
        d2 = sum(((x[c] - F.col(f"lab_{c}")) * (x[c] - F.col(f"lab_{c}")) for c in "lab"), kernel.lit(0))
        return F.struct(d2.alias("d2"), x["name"].alias("name"), x["hex"].alias("hex"))

    best = placed.withColumn("_best", F.array_min(F.transform(_named_lab_array(), scored)))
    best = best.withColumns({"name": F.col("_best.name"), "name_hex": F.col("_best.hex"), "distance": F.sqrt("_best.d2")})
    exact = (F.col("distance") < NEAR_EXACT) | (F.col("name_hex") == kernel.hex_text(F.col("r"), F.col("g"), F.col("b")))
    suffix = F.concat(F.col("name"), F.lit(" (ΔE="), kernel.compact(F.col("distance"), 2), F.lit(")"))
    return best.withColumn("label", F.when(exact, F.col("name")).otherwise(suffix)).drop("_best", "lab_l", "lab_a", "lab_b")


def with_spaces(colors: DataFrame) -> DataFrame:
    """Add HSL, HSV, Lab, LCH, OkLab and OkLCH components."""
    df = kernel.with_hsv(kernel.with_hsl(colors))
    df = kernel.with_lab(df)
    a, b = F.col("lab_a"), F.col("lab_b")
    df = df.withColumns({"lch_c": F.sqrt(a * a + b * b), "lch_h": kernel.hue_of(a, b)})
    return kernel.with_oklch(df)


def with_metrics(colors: DataFrame) -> DataFrame:
    """Add luminance, HSL lightness / hue / saturation, OkLab L and OkLCH chroma."""
    r, g, b = (F.col(c) for c in "rgb")
    df = colors.withColumns(
        {
            "luminance": kernel.luminance(r, g, b),
            "lightness": kernel.hsl_lightness(r, g, b),
            "hue": kernel.hue(r, g, b),
            "saturation": kernel.hsl_saturation(r, g, b),
        }
    )
    return kernel.with_oklch(df).withColumnRenamed("ok_l", "okl").withColumnRenamed("ok_c", "ok_chroma").drop("ok_a", "ok_b", "ok_h")


NOTATIONS = ["hex", "hex-upper", "rgb", "hsl", "hsv", "hls", "lab", "lch", "oklab", "oklch", "int"]


def notation_text(notation: str) -> Column:
    """CSS text of one notation over ``with_spaces`` columns and ``a``."""
    r, g, b, a = (F.col(c) for c in "rgba")
    whole = kernel.round_int
    fmt = F.format_string
    alpha = kernel.alpha_text(a)

    def tail(name: str, body: Column) -> Column:
        return F.when(a == 255, F.concat(F.lit(f"{name}("), body, F.lit(")"))).otherwise(
            F.concat(F.lit(f"{name if name not in ('hsl', 'hsv') else name + 'a'}("), body, F.lit(" / "), alpha, F.lit(")"))
        )

    def percent(name: str) -> Column:
        return whole(F.col(name) * 100.0)

    if notation == "hex":
        return kernel.hex_text(r, g, b, a)
    if notation == "hex-upper":
        return kernel.hex_text(r, g, b, a, upper=True)
    if notation == "int":
        return F.when(a == 255, fmt("0x%02X%02X%02X", r, g, b)).otherwise(fmt("0x%02X%02X%02X%02X", r, g, b, a))
    if notation == "rgb":
        opaque = fmt("rgb(%d, %d, %d)", r, g, b)
        return F.when(a == 255, opaque).otherwise(F.concat(fmt("rgba(%d, %d, %d, ", r, g, b), alpha, F.lit(")")))
    if notation in ("hsl", "hsv"):
        third = percent("hsl_l" if notation == "hsl" else "hsv_v")
        return tail(notation, fmt("%d %d%% %d%%", whole(F.col(f"{notation}_h")), percent(f"{notation}_s"), third))
    if notation == "hls":
        parts = [kernel.compact(v, 4) for v in (F.col("hsl_h") / 360.0, F.col("hsl_l"), F.col("hsl_s"))]
        return tail("hls", F.concat_ws(" ", *parts))
    if notation == "lab":
        return tail("lab", fmt("%d %d %d", *[whole(F.col(f"lab_{c}")) for c in "lab"]))
    if notation == "lch":
        return tail("lch", fmt("%d %d %d", whole(F.col("lab_l")), whole(F.col("lch_c")), whole(F.col("lch_h"))))
    if notation == "oklab":
        return tail("oklab", F.concat_ws(" ", *[kernel.compact(F.col(f"ok_{c}"), 4) for c in "lab"]))
    if notation == "oklch":
        digits = {"l": 4, "c": 4, "h": 1}
        return tail("oklch", F.concat_ws(" ", *[kernel.compact(F.col(f"ok_{c}"), d) for c, d in digits.items()]))
    raise ValueError(f"unknown notation {notation!r}")
