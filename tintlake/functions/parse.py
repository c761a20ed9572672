"""Colour strings to channels as one Column expression; malformed input yields nulls and a reason."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K
from . import kernel

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Functional notations by argument order; rgba/hsla/hsva are aliases.
FAMILIES = {"rgb": "rgb", "rgba": "rgb", "hsl": "hsl", "hsla": "hsl", "hsv": "hsv", "hsva": "hsv",
            "hls": "hls", "lab": "lab", "lch": "lch", "oklab": "oklab", "oklch": "oklch"}


def _number(token: Column) -> Column:
    return F.when(token.rlike(NUMBER), token.cast("double"))


def _byte_value(token: Column, whole: float) -> Column:
    """Value on 0..255: ``n%`` of 255, or a bare number whose full scale is ``whole``."""
    share = _number(F.regexp_replace(token, "%$", "")) / 100.0 * 255.0
    return F.when(token.endswith("%"), share).otherwise(_number(token) * (255.0 / whole))


def _round_byte(v: Column) -> Column:
    return F.floor(kernel.clamp(v, 0.0, 255.0) + 0.5).cast("int")


def _unit(token: Column) -> Column:
    """Fraction: ``n%``, or a bare number where values above one are percentages."""
    bare = _number(token)
    return F.when(token.endswith("%"), _number(F.regexp_replace(token, "%$", "")) / 100.0).otherwise(
        F.when(bare > 1, bare / 100.0).otherwise(bare)
    )


def _angle(token: Column) -> Column:
    """Degrees in [0, 360); deg, turn, grad and rad suffixes."""
    low = F.lower(token)
    value = _number(F.regexp_replace(low, "(deg|turn|grad|rad)$", ""))
    factor = (
        F.when(low.endswith("turn"), 360.0)
        .when(low.endswith("grad"), 0.9)
        .when(low.endswith("rad"), 180.0 / math.pi)
        .otherwise(1.0)
    )
    return kernel.wrap(value * factor)


def _named_map() -> Column:
    body = ",".join(f"'{name}','{code}'" for name, code in K.NAMED)
    return F.expr(f"map({body})")


def with_parsed(df: DataFrame, raw: str) -> DataFrame:
    """Add ``notation``, ``r, g, b, a`` and ``error`` for the colour text in ``raw``; no row is dropped."""
    text = F.trim(F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"^\s+|\s+$", ""))
    df = df.withColumn("_t", text).withColumn("_low", F.lower("_t"))
    t, low = F.col("_t"), F.col("_low")
    name = F.regexp_replace(low, "[-_ ]", "")
    is_function = t.contains("(")
    prefixed = low.startswith("#") | low.startswith("0x")
    df = df.withColumn("_named", F.when(~is_function & ~prefixed, F.element_at(_named_map(), name)))
    bare = low.rlike("^([0-9a-f]{3}|[0-9a-f]{4}|[0-9a-f]{6}|[0-9a-f]{8})$")
    fn = F.trim(F.lower(F.substring_index(t, "(", 1)))
    family = F.element_at(F.expr("map(" + ",".join(f"'{k}','{v}'" for k, v in FAMILIES.items()) + ")"), fn)
    df = df.withColumn(
        "notation",
        F.when(t == "", "empty")
        .when(is_function, F.coalesce(family, F.lit("function?")))
        .when(prefixed, "hex")
        .when(F.col("_named").isNotNull(), "named")
        .when(bare, "hex")
        .otherwise("unknown"),
    )

    # hex digits after the optional prefixes, short forms doubled, alpha completed
    digits = F.regexp_replace(F.regexp_replace(low, "^#", ""), "^0x", "")
    digits = F.when(F.col("notation") == "named", F.col("_named")).otherwise(digits)
    doubled = F.when(F.length(digits).isin(3, 4), F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    whole = F.when(F.length(doubled) == 6, F.concat(doubled, F.lit("ff"))).otherwise(doubled)
    df = df.withColumn("_hex", F.when(whole.rlike("^[0-9a-f]{8}$"), whole))

    # function arguments between the first '(' and the last ')'
    inner = F.regexp_extract(t, r"^[^(]*\((.*)\)[^)]*$", 1)
    tokens = F.filter(F.split(F.regexp_replace(inner, "[,/]", " "), r"\s+"), lambda x: x != "")
    df = df.withColumn("_args", F.when(is_function & F.col("_t").rlike(r"^[^(]*\(.*\)"), tokens))
    df = kernel.fence(df, {c: F.col(c) for c in ("notation", "_hex", "_args")}).drop("_t", "_low", "_named")
    df = df.withColumn("_ok", F.coalesce(F.size("_args").isin(3, 4), F.lit(False)))
    arg = [F.get("_args", F.lit(i)) for i in range(4)]
    fourth = _byte_value(arg[3], 1.0)
    alpha = F.when(F.size("_args") == 4, F.when(fourth.isNotNull(), _round_byte(fourth))).otherwise(255)

    u1, u2 = _unit(arg[1]), _unit(arg[2])
    n1, n2 = _number(arg[1]), _number(arg[2])
    kind = F.col("notation")
    turn = _number(arg[0])
    hls_hue = F.when(F.lower(arg[0]).rlike("(deg|turn|grad|rad|%)$"), _angle(arg[0])).otherwise(
        kernel.wrap(F.when(turn <= 1, turn * 360.0).otherwise(turn))
    )
    df = kernel.fence(
        df,
        {
            "_x": F.when(kind == "rgb", _byte_value(arg[0], 255.0))
            .when(kind.isin("hsl", "hsv"), _angle(arg[0]))
            .when(kind == "hls", hls_hue)
            .when(kind.isin("lab", "lch", "oklab", "oklch"), _unit(arg[0])),
            "_y": F.when(kind == "rgb", _byte_value(arg[1], 255.0))
            .when(kind.isin("hsl", "hsv"), u1)
            .when(kind == "hls", u2)
            .when(kind.isin("lab", "lch", "oklab", "oklch"), n1),
            "_z": F.when(kind == "rgb", _byte_value(arg[2], 255.0))
            .when(kind.isin("hsl", "hsv"), u2)
            .when(kind == "hls", u1)
            .when(kind.isin("lch", "oklch"), _angle(arg[2]))
            .when(kind.isin("lab", "oklab"), n2),
            "_alpha": alpha,
        },
    )
    x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
    df = df.withColumn("_full", F.col("_ok") & x.isNotNull() & y.isNotNull() & z.isNotNull() & F.col("_alpha").isNotNull())
    df = df.withColumn("_full", F.coalesce("_full", F.lit(False)))
    # Three families of conversion cover the notations: polar forms become Cartesian first.
    cart_a, cart_b = kernel.polar(y, z)
    cylinder = kind.isin("lch", "oklch")
    df = df.withColumns({"_ca": F.when(cylinder, cart_a).otherwise(y), "_cb": F.when(cylinder, cart_b).otherwise(z)})
    ca, cb = F.col("_ca"), F.col("_cb")
    df = kernel.with_hsl_bytes(df, x, y, z, ("_r_hsl", "_g_hsl", "_b_hsl"))
    df = kernel.with_hsv_bytes(df, x, y, z, ("_r_hsv", "_g_hsv", "_b_hsv"))
    df = kernel.with_lab_bytes(df, x * 100.0, ca, cb, ("_r_lab", "_g_lab", "_b_lab"))
    df = kernel.with_oklab_bytes(df, x, ca, cb, ("_r_ok", "_g_ok", "_b_ok"))
    suffix = {"hsl": "hsl", "hls": "hsl", "hsv": "hsv", "lab": "lab", "lch": "lab", "oklab": "ok", "oklch": "ok"}
    out = {}
    for i, (channel, source) in enumerate(zip("rgb", (x, y, z))):
        value = F.conv(F.substring("_hex", 2 * i + 1, 2), 16, 10).cast("int")
        picked = F.when(kind.isin("hex", "named"), value).when(~F.col("_full"), F.lit(None).cast("int"))
        picked = picked.when(kind == "rgb", _round_byte(source))
        for notation, tail in suffix.items():
            picked = picked.when(kind == notation, F.col(f"_{channel}_{tail}"))
        out[channel] = picked
    out["a"] = F.when(kind.isin("hex", "named"), F.conv(F.substring("_hex", 7, 2), 16, 10).cast("int")).when(
        F.col("_full") & kind.isin("rgb", *suffix), F.col("_alpha").cast("int")
    )
    ways = ["rgb", *suffix]
    reason = (
        F.when(kind == "empty", "empty input")
        .when(kind == "unknown", "cannot parse")
        .when((kind == "hex") & F.col("_hex").isNull(), "invalid hex")
        .when(kind == "function?", "unsupported function")
        .when(kind.isin(*ways) & F.col("_args").isNull(), "not a function color")
        .when(kind.isin(*ways) & ~F.col("_ok"), "needs 3-4 args")
        .when(kind.isin(*ways) & ~F.col("_full"), "bad argument")
    )
    df = df.withColumns({**out, "error": reason})
    return df.drop("_hex", "_args", "_ok", "_x", "_y", "_z", "_alpha", "_full", "_ca", "_cb", *[f"_{c}_{t}" for c in "rgb" for t in ("hsl", "hsv", "lab", "ok")])
