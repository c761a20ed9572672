"""Colour-space arithmetic as Columns.

Channels r, g, b are integers 0..255. Functions taking and returning Columns stay inside whole-stage
codegen; the ``with_*`` helpers stage shared intermediates as columns so that one row evaluates each
of them once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K


def lit(value: float) -> Column:
    return F.lit(float(value))


def dot(weights: list[float], cols: list[Column]) -> Column:
    terms = [lit(w) * c for w, c in zip(weights, cols)]
    return terms[0] + terms[1] + terms[2]


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Clamp; note that greatest / least skip nulls, so callers guard them."""
    return F.greatest(lit(low), F.least(lit(high), v))


def byte(unit: Column) -> Column:
    """Unit value to 0..255: clamp, then round half up (equal to half away from zero when >= 0)."""
    return F.floor(clamp(unit) * 255.0 + 0.5).cast("int")


def wrap(deg: Column) -> Column:
    return F.pmod(deg, lit(360))


def staged(df: DataFrame, *stages: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """Apply projections one after another, so that shared intermediates are columns, not repeated trees."""
    for stage in stages:
        df = df.withColumns(stage)
    return df.drop(*drop) if drop else df


def fence(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns through a one-element ``inline``: evaluated once per row, in codegen, and never
    substituted into filters or projections above, which would repeat long trees many times over."""
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(n) for n, v in cols.items()]))))


# --- transfer function -------------------------------------------------------------------------------


def _linear(i: int) -> float:
    v = i / 255
    return v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4


_LINEAR_TABLE = "array(" + ",".join(f"{_linear(i)!r}D" for i in range(256)) + ")"


def linear(channel: Column) -> Column:
    """Byte channel to linear light through a 256-entry literal array (no pow per row)."""
    return F.get(F.expr(_LINEAR_TABLE), channel.cast("int"))


def gamma(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, lit(1 / 2.4)) * 1.055 - 0.055)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return dot(K.LUMA, [linear(r), linear(g), linear(b)])


# --- OkLab ---------------------------------------------------------------------------------------------


def hue_of(a: Column, b: Column) -> Column:
    return wrap(F.degrees(F.atan2(b, a)))


def _grey_hue(i: int) -> float:
    light = _linear(i)
    roots = [math.cbrt(row[0] * light + row[1] * light + row[2] * light) for row in K.OKLAB_LMS]
    a, b = (row[0] * roots[0] + row[1] * roots[1] + row[2] * roots[2] for row in K.OKLAB_FROM_LMS[1:])
    deg = math.degrees(math.atan2(b, a))
    return deg - 360 * math.floor(deg / 360)


_GREY_HUES = "array(" + ",".join(f"{_grey_hue(i)!r}D" for i in range(256)) + ")"


def stable_hue(r: Column, g: Column, b: Column, hue: Column) -> Column:
    """OkLCH hue, of greys from a table: their chroma is some 1e-8, so that the last bits of a cube root move their hue by 1e-6."""
    return F.when((r == g) & (g == b), F.get(F.expr(_GREY_HUES), r.cast("int"))).otherwise(hue)


def polar(c: Column, h: Column) -> tuple[Column, Column]:
    rad = h * lit(math.pi) / 180.0
    return c * F.cos(rad), c * F.sin(rad)


def with_oklab(df: DataFrame, r="r", g="g", b="b", p="ok_") -> DataFrame:
    """Add OkLab ``{p}l, {p}a, {p}b``."""
    rgb = [F.col("_lr"), F.col("_lg"), F.col("_lb")]
    roots = ["_r0", "_r1", "_r2"]
    return staged(
        df,
        {"_lr": linear(F.col(r)), "_lg": linear(F.col(g)), "_lb": linear(F.col(b))},
        {n: F.cbrt(dot(row, rgb)) for n, row in zip(roots, K.OKLAB_LMS)},
        {p + n: dot(row, [F.col(c) for c in roots]) for n, row in zip("lab", K.OKLAB_FROM_LMS)},
        drop=("_lr", "_lg", "_lb", *roots),
    )


def with_oklch(df: DataFrame, r="r", g="g", b="b", p="ok_") -> DataFrame:
    """Add OkLab plus chroma ``{p}c`` and hue ``{p}h`` in degrees."""
    df = with_oklab(df, r, g, b, p)
    a, bb = F.col(f"{p}a"), F.col(f"{p}b")
    return df.withColumns({f"{p}c": F.sqrt(a * a + bb * bb), f"{p}h": hue_of(a, bb)})


def _linear_to_bytes(df: DataFrame, rows: list[list[float]], basis: list[str], out: tuple[str, ...]) -> DataFrame:
    cols = [F.col(c) for c in basis]
    lights = ["_v0", "_v1", "_v2"]
    return staged(
        df,
        {n: dot(row, cols) for n, row in zip(lights, rows)},
        {o: byte(gamma(F.col(n))) for o, n in zip(out, lights)},
        drop=(*lights, *basis),
    )


def with_oklab_bytes(df: DataFrame, L: Column, a: Column, b: Column, out=("r", "g", "b")) -> DataFrame:
    """Add sRGB bytes of OkLab values; out-of-gamut channels are clamped."""
    roots, cubes = ["_q0", "_q1", "_q2"], ["_u0", "_u1", "_u2"]
    df = staged(
        df,
        {"_L": L, "_A": a, "_B": b},
        {n: F.col("_L") + lit(wa) * F.col("_A") + lit(wb) * F.col("_B") for n, (wa, wb) in zip(roots, K.OKLAB_TO_LMS)},
        {u: F.col(n) * F.col(n) * F.col(n) for u, n in zip(cubes, roots)},
        drop=("_L", "_A", "_B", *roots),
    )
    return _linear_to_bytes(df, K.OKLAB_LMS_TO_RGB, cubes, out)


def with_oklch_bytes(df: DataFrame, L: Column, c: Column, h: Column, out=("r", "g", "b")) -> DataFrame:
    df = staged(df, {"_pl": L, "_pc": c, "_ph": h})
    a, b = polar(F.col("_pc"), F.col("_ph"))
    return with_oklab_bytes(df, F.col("_pl"), a, b, out).drop("_pl", "_pc", "_ph")


# --- CIE Lab -----------------------------------------------------------------------------------------------


def with_lab(df: DataFrame, r="r", g="g", b="b", p="lab_") -> DataFrame:
    """Add CIE Lab on the CSS scale (L 0..100)."""
    rgb = [F.col("_lr"), F.col("_lg"), F.col("_lb")]
    xyz, f = ["_x0", "_x1", "_x2"], ["_f0", "_f1", "_f2"]

    def bend(t: Column) -> Column:
        return F.when(t > (6 / 29) ** 3, F.cbrt(t)).otherwise(t / 3.0 * lit((29 / 6) ** 2) + lit(4 / 29))

    fx, fy, fz = (F.col(n) for n in f)
    return staged(
        df,
        {"_lr": linear(F.col(r)), "_lg": linear(F.col(g)), "_lb": linear(F.col(b))},
        {n: dot(row, rgb) / lit(w) for n, row, w in zip(xyz, K.RGB_TO_XYZ, K.D65)},
        {n: bend(F.col(x)) for n, x in zip(f, xyz)},
        {f"{p}l": fy * 116.0 - 16.0, f"{p}a": (fx - fy) * 500.0, f"{p}b": (fy - fz) * 200.0},
        drop=("_lr", "_lg", "_lb", *xyz, *f),
    )


def with_lab_bytes(df: DataFrame, L: Column, a: Column, b: Column, out=("r", "g", "b")) -> DataFrame:
    """Add sRGB bytes of CIE Lab values on the CSS scale."""
    f, xyz = ["_f0", "_f1", "_f2"], ["_x0", "_x1", "_x2"]

    def unbend(t: Column) -> Column:
        return F.when(t > 6 / 29, t * t * t).otherwise((t - lit(4 / 29)) * lit(3 * (6 / 29) ** 2))

    df = staged(
        df,
        {"_f1": (L + 16.0) / 116.0, "_fa": a / 500.0, "_fb": b / 200.0},
        {"_f0": F.col("_f1") + F.col("_fa"), "_f2": F.col("_f1") - F.col("_fb")},
        {x: unbend(F.col(n)) * lit(w) for x, n, w in zip(xyz, f, K.D65)},
        drop=(*f, "_fa", "_fb"),
    )
    return _linear_to_bytes(df, K.XYZ_TO_RGB, xyz, out)


# --- HSL / HSV ---------------------------------------------------------------------------------------------


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees shared by HSL, HSV and HLS; 0 for neutrals."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = (hi - lo).cast("double")
    sextant = (
        F.when(hi == lo, lit(0))
        .when(hi == r, (g - b) / d)
        .when(hi == g, (b - r) / d + 2.0)
        .otherwise((r - g) / d + 4.0)
    )
    return wrap(sextant * 60.0)


def hsl_lightness(r: Column, g: Column, b: Column) -> Column:
    return (F.greatest(r, g, b) + F.least(r, g, b)) / 510.0


def hsl_saturation(r: Column, g: Column, b: Column) -> Column:
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    total = hi + lo
    return (
        F.when(hi == lo, lit(0))
        .when(total < 255, (hi - lo) / total)
        .otherwise((hi - lo) / (F.lit(510) - total))
    )


def hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return hue(r, g, b), hsl_saturation(r, g, b), hsl_lightness(r, g, b)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    s = F.when(hi == 0, lit(0)).otherwise((hi - lo) / hi)
    return hue(r, g, b), s, hi / 255.0


def _fan(df: DataFrame, h: Column, s: Column, v: Column, turn: float, steps: tuple[int, ...]) -> DataFrame:
    df = staged(df, {"_sec": wrap(h) / turn, "_s": clamp(s), "_v": clamp(v)})
    return df.withColumns({f"_k{n}": F.pmod(F.col("_sec") + float(n), lit(360 / turn)) for n in steps})


def with_hsl_bytes(df: DataFrame, h: Column, s: Column, l: Column, out=("r", "g", "b")) -> DataFrame:
    steps = (0, 8, 4)
    df = _fan(df, h, s, l, 30.0, steps)
    light, amp = F.col("_v"), F.col("_s") * F.least(F.col("_v"), lit(1) - F.col("_v"))

    def channel(k: Column) -> Column:
        return byte(light - amp * F.greatest(lit(-1), F.least(k - 3.0, lit(9) - k, lit(1))))

    df = df.withColumns({o: channel(F.col(f"_k{n}")) for o, n in zip(out, steps)})
    return df.drop("_sec", "_s", "_v", *[f"_k{n}" for n in steps])


def with_hsv_bytes(df: DataFrame, h: Column, s: Column, v: Column, out=("r", "g", "b")) -> DataFrame:
    steps = (5, 3, 1)
    df = _fan(df, h, s, v, 60.0, steps)
    value, depth = F.col("_v"), F.col("_v") * F.col("_s")

    def channel(k: Column) -> Column:
        return byte(value - depth * F.greatest(lit(0), F.least(k, lit(4) - k, lit(1))))

    df = df.withColumns({o: channel(F.col(f"_k{n}")) for o, n in zip(out, steps)})
    return df.drop("_sec", "_s", "_v", *[f"_k{n}" for n in steps])


def with_hsl(df: DataFrame, r="r", g="g", b="b", p="hsl_") -> DataFrame:
    h, s, l = hsl(F.col(r), F.col(g), F.col(b))
    return df.withColumns({f"{p}h": h, f"{p}s": s, f"{p}l": l})


def with_hsv(df: DataFrame, r="r", g="g", b="b", p="hsv_") -> DataFrame:
    h, s, v = hsv(F.col(r), F.col(g), F.col(b))
    return df.withColumns({f"{p}h": h, f"{p}s": s, f"{p}v": v})


# --- hue wheel ---------------------------------------------------------------------------------------------


_HUES = K.RYB_RGB_HUES
_STEP = 360 / (len(_HUES) - 1)


def ryb_to_rgb_hue(ryb: Column) -> Column:
    """Artist-wheel angle to HSL hue: the anchor index is arithmetic, so two array look-ups suffice."""
    anchors = F.expr("array(" + ",".join(f"{h}D" for h in _HUES) + ")")
    seg = wrap(ryb) / lit(_STEP)
    i = F.floor(seg).cast("int")
    lo = F.get(anchors, i)
    return lo + (F.get(anchors, i + 1) - lo) * (seg - i)


def rgb_to_ryb_hue(rgb: Column) -> Column:
    """Inverse of ``ryb_to_rgb_hue``: 24 half-open segments as one CASE ladder."""
    h = wrap(rgb)
    ladder = None
    for i, (lo, hi) in enumerate(zip(_HUES, _HUES[1:])):
        branch = (lit(i) + (h - lit(lo)) / lit(hi - lo)) * lit(_STEP)
        ladder = F.when(h < lit(hi), branch) if ladder is None else ladder.when(h < lit(hi), branch)
    return ladder


# --- gamut -------------------------------------------------------------------------------------------------


GAMUT_SLACK = 1e-4
GAMUT_STEPS = 16


def with_clipped_chroma(df: DataFrame, L: str, c: str, h: str, out: str, inside: str | None = None) -> DataFrame:
    """Largest chroma <= c inside sRGB at fixed lightness and hue, by 16 halvings.

    Along a ray of fixed lightness and hue every linear channel is a cubic in chroma. Its coefficients are
    plain columns, so a halving is three Horner evaluations inside one short fold. ``inside`` also keeps the
    gamut test of c itself.
    """
    cos, sin = polar(lit(1), F.col(h))
    slopes = ["_k0", "_k1", "_k2"]
    df = staged(
        df,
        {"_cos": cos, "_sin": sin},
        {k: lit(wa) * F.col("_cos") + lit(wb) * F.col("_sin") for k, (wa, wb) in zip(slopes, K.OKLAB_TO_LMS)},
    )
    light, k = F.col(L), [F.col(s) for s in slopes]
    powers = [[light * light * light] * 3, [light * light * x * 3.0 for x in k], [light * x * x * 3.0 for x in k], [x * x * x for x in k]]
    coefs = {f"_p{ch}{n}": dot(row, powers[n]) for ch, row in enumerate(K.OKLAB_LMS_TO_RGB) for n in range(4)}
    df = df.withColumns(coefs)

    def fits(chroma: Column) -> Column:
        v = []
        for ch in range(3):
            p = [F.col(f"_p{ch}{n}") for n in range(4)]
            v.append(((p[3] * chroma + p[2]) * chroma + p[1]) * chroma + p[0])
        return (F.least(*v) >= -GAMUT_SLACK) & (F.greatest(*v) <= 1 + GAMUT_SLACK)

    def halve(span: Column, step: Column) -> Column:
        mid = span["lo"] + step
        return F.struct(F.when(fits(mid), mid).otherwise(span["lo"]).alias("lo"))

    steps = F.array(*[F.col(c) * 0.5 ** (i + 1) for i in range(GAMUT_STEPS)])
    edge = F.aggregate(steps, F.struct(lit(0).alias("lo")), halve, lambda span: span["lo"])
    df = df.withColumn("_whole", fits(F.col(c)))
    picked = F.when(F.col(c) <= 0, lit(0)).when(F.col("_whole"), F.col(c)).otherwise(edge)
    added = {out: picked} if inside is None else {out: picked, inside: F.col("_whole")}
    return df.withColumns(added).drop("_cos", "_sin", "_whole", *slopes, *coefs)


# --- text -------------------------------------------------------------------------------------------------


def round_int(v: Column) -> Column:
    """Round half away from zero."""
    return (F.signum(v) * F.floor(F.abs(v) + 0.5)).cast("int")


def compact(v: Column, digits: int) -> Column:
    """Fixed decimals with trailing zeros and a bare point dropped."""
    text = F.format_string(f"%.{digits}f", v)
    trimmed = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return trimmed


def alpha_text(a: Column) -> Column:
    return F.when(a == 0, "0").when(a == 255, "1").otherwise(compact(a / 255.0, 3))


def hex_text(r: Column, g: Column, b: Column, a: Column | None = None, upper: bool = False) -> Column:
    style = "%02X" if upper else "%02x"
    opaque = F.format_string("#" + style * 3, r, g, b)
    if a is None:
        return opaque
    return F.when(a == 255, opaque).otherwise(F.format_string("#" + style * 4, r, g, b, a))


def saliency(n: Column, saturation: Column) -> Column:
    return F.log(n + 1.0) * F.pow(saturation + K.SALIENCY_FLOOR, lit(K.SALIENCY_POWER))
