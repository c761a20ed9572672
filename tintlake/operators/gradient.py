"""Gradient tables from colour stops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernel
from ..runtime import salted_join

SPACES = ["rgb", "lab", "oklab", "oklch", "hsl"]
EASINGS = ["linear", "ease-in", "ease-out", "ease-in-out"]
# CSS names of the interpolation spaces.
CSS_SPACE = {"rgb": "srgb", "lab": "lab", "oklab": "oklab", "oklch": "oklch", "hsl": "hsl"}


def ease(t: Column, easing: str) -> Column:
    if easing == "linear":
        return t
    if easing == "ease-in":
        return t * t
    if easing == "ease-out":
        return kernel.lit(1) - (kernel.lit(1) - t) * (kernel.lit(1) - t)
    if easing == "ease-in-out":
        return t * t * (kernel.lit(3) - t * 2.0)
    raise ValueError(f"unknown easing {easing!r}")


def _mix(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def _mix_hue(a: Column, b: Column, t: Column) -> Column:
    """Shortest arc."""
    d = b - a
    return kernel.wrap(a + (d - F.when(d > 180, 360.0).when(d < -180, -360.0).otherwise(0.0)) * t)


A, B = ("ar", "ag", "ab"), ("br", "bg", "bb")


def blend(df: DataFrame, t: Column, space: str) -> DataFrame:
    """Add r, g, b between colours a* and b* at ``t`` in the given space."""
    c = F.col
    df = df.withColumn("_t", t)
    tt = c("_t")
    if space == "rgb":
        return df.withColumns(
            {o: F.floor(kernel.clamp(_mix(c(x).cast("double"), c(y), tt), 0, 255) + 0.5).cast("int") for o, x, y in zip("rgb", A, B)}
        ).drop("_t")
    if space == "hsl":
        df = kernel.with_hsl(kernel.with_hsl(df, *A, p="_1"), *B, p="_2")
        h = _mix_hue(c("_1h"), c("_2h"), tt)
        out = kernel.with_hsl_bytes(df, h, _mix(c("_1s"), c("_2s"), tt), _mix(c("_1l"), c("_2l"), tt))
        return out.drop("_t", *[f"_{i}{n}" for i in "12" for n in "hsl"])
    adders = {"lab": kernel.with_lab, "oklab": kernel.with_oklab, "oklch": kernel.with_oklch}
    if space not in adders:
        raise ValueError(f"unknown space {space!r}")
    df = adders[space](adders[space](df, *A, p="_1"), *B, p="_2")
    temps = [f"_{i}{n}" for i in "12" for n in "labch"]
    if space == "oklch":
        out = kernel.with_oklch_bytes(df, _mix(c("_1l"), c("_2l"), tt), _mix(c("_1c"), c("_2c"), tt), _mix_hue(c("_1h"), c("_2h"), tt))
    else:
        mixed = [_mix(c(f"_1{n}"), c(f"_2{n}"), tt) for n in "lab"]
        out = (kernel.with_lab_bytes if space == "lab" else kernel.with_oklab_bytes)(df, *mixed)
    return out.drop("_t", *temps)


def segments(stops: DataFrame, steps: int) -> DataFrame:
    """Consecutive stops of each valid ramp as one row with ``p0, p1`` and both colours; ``last`` marks the closing one.

    Ramps that ``invalid_ramps`` names have no segments, and no other check is made later. A valid ramp has at most
    ``steps`` stops, so no window is larger.
    """
    refused = invalid_ramps(stops, steps).select("ramp_id")
    stops = salted_join(stops, refused, ["ramp_id"], F.col("ord"), "left_anti")
    order = Window.partitionBy("ramp_id").orderBy("ord")
    nxt = {f"b{n}": F.lead(n).over(order) for n in "rgb"}
    df = stops.select("ramp_id", "ord", F.col("pos").alias("p0"), F.lead("pos").over(order).alias("p1"),
                      F.lead("pos", 2).over(order).isNull().alias("last"),
                      *[F.col(n).alias(f"a{n}") for n in "rgb"], *[v.alias(n) for n, v in nxt.items()])
    return df.filter(F.col("p1").isNotNull())


def even_positions(stops: DataFrame) -> DataFrame:
    n = stops.groupBy("ramp_id").agg(F.count("*").alias("_n"))
    return salted_join(stops, n, ["ramp_id"], F.col("ord")).withColumn("pos", F.col("ord") / (F.col("_n") - 1)).drop("_n")


def invalid_ramps(stops: DataFrame, steps: int) -> DataFrame:
    """Ramps that cannot be built, with the reason."""
    before = stops.select("ramp_id", (F.col("ord") + 1).alias("ord"), F.col("pos").alias("_before"))
    gaps = stops.join(before, ["ramp_id", "ord"], "left").withColumn("_gap", F.col("pos") - F.col("_before"))
    seen = gaps.groupBy("ramp_id").agg(
        F.count("*").alias("n"), F.min("_gap").alias("gap"), F.min_by("pos", "ord").alias("first"), F.max_by("pos", "ord").alias("final")
    )
    reason = (
        F.when(F.col("n") < 2, "fewer than two stops")
        .when(F.col("n") > steps, "more stops than steps")
        .when((F.col("first") != 0) | (F.col("final") != 1), "positions do not run from 0 to 1")
        .when(F.col("gap") <= 0, "positions do not grow")
    )
    return seen.select("ramp_id", reason.alias("error")).filter(F.col("error").isNotNull())


def ramps(stops: DataFrame, steps: int, space: str = "oklab", easing: str = "linear") -> DataFrame:
    """``ramp_table`` of the valid ramps, and one row with the reason in ``error`` for each of the others."""
    good = ramp_table(segments(stops, steps), steps, space, easing).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(invalid_ramps(stops, steps), allowMissingColumns=True)


def ramp_table(segs: DataFrame, steps: int, space: str = "oklab", easing: str = "linear") -> DataFrame:
    """``steps`` samples of every ramp: rows (ramp_id, ord, r, g, b).

    Each segment produces its own samples directly: the eased parameter is monotone, so the samples in
    [p0, p1) are found by filtering the fixed list of steps inside the row, without joining samples to segments.
    """
    if steps < 2:
        raise ValueError("fewer than two steps")
    eased = F.expr("array(" + ",".join(f"{_ease_value(i / (steps - 1), easing)!r}D" for i in range(steps)) + ")")
    df = segs.select("ramp_id", "p0", "p1", "last", *A, *B, F.posexplode(eased).alias("i", "t"))
    inside = (F.col("t") >= F.col("p0")) & ((F.col("t") < F.col("p1")) | F.col("last"))
    first, final = F.col("i") == 0, F.col("i") == steps - 1
    df = df.filter(F.when(first, F.col("p0") == 0).when(final, F.col("last")).otherwise(inside))
    local = F.when(F.col("p1") > F.col("p0"), (F.col("t") - F.col("p0")) / (F.col("p1") - F.col("p0"))).otherwise(0.0)
    df = blend(df, local, space)
    # end stops are verbatim
    exact = [F.when(first, F.col(x)).when(final, F.col(y)).otherwise(F.col(c)).alias(c) for c, x, y in zip("rgb", A, B)]
    return df.select("ramp_id", F.col("i").alias("ord"), *exact)


def _ease_value(t: float, easing: str) -> float:
    """Same curves as ``ease`` for the constant list of steps."""
    return {"linear": t, "ease-in": t * t, "ease-out": 1 - (1 - t) * (1 - t), "ease-in-out": t * t * (3 - 2 * t)}[easing]


def two_stop(ends: DataFrame, key: str, steps: int, space: str = "oklab", easing: str = "linear") -> DataFrame:
    """Gradients between the ends a* and b* of every row."""
    if steps < 2:
        raise ValueError("fewer than two steps")
    df = ends.select(key, *A, *B, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("ord"))
    df = blend(df, ease(F.col("ord") / float(steps - 1), easing), space)
    first, final = F.col("ord") == 0, F.col("ord") == steps - 1
    exact = [F.when(first, F.col(x)).when(final, F.col(y)).otherwise(F.col(c)).alias(c) for c, x, y in zip("rgb", A, B)]
    return df.select(key, "ord", *exact)


def in_all(build, labels: list[str], name: str) -> DataFrame:
    """Union of ``build(label)`` tagged with the label."""
    return reduce(DataFrame.unionByName, [build(x).withColumn(name, F.lit(x)) for x in labels])
