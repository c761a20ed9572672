"""Palette generation around base colours: harmonies, shades, random palettes, slot merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import kernel

V_FLOOR = 0.20


def resolve_types(requests: DataFrame, col: str = "type") -> DataFrame:
    """Canonical harmony name in ``resolved``, or null with ``error``; aliases and case are folded."""
    low = F.lower(F.trim(F.col(col)))
    aliased = low
    for alias, name in K.HARMONY_ALIASES.items():
        aliased = F.when(low == alias, name).otherwise(aliased)
    known = aliased.isin(*K.HARMONY_TYPES)
    return requests.withColumns(
        {"resolved": F.when(known, aliased), "error": F.when(~known, F.concat(F.lit("unknown harmony type "), F.col(col)))}
    )


def _slots(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.explode(F.sequence(F.lit(0), n - 1))


def rotate(bases: DataFrame, offset: Column) -> DataFrame:
    """Turn each base by ``offset`` artist-wheel degrees, HSL S and L kept; offset 0 keeps it verbatim."""
    df = kernel.staged(
        bases.withColumn("_off", offset.cast("double")),
        {"_hh": kernel.hue(*_rgb()), "_hs": kernel.hsl_saturation(*_rgb()), "_hl": kernel.hsl_lightness(*_rgb())},
        {"_wheel": kernel.wrap(kernel.rgb_to_ryb_hue(F.col("_hh")) + F.col("_off"))},
    )
    df = kernel.with_hsl_bytes(df, kernel.ryb_to_rgb_hue(F.col("_wheel")), F.col("_hs"), F.col("_hl"), ("_nr", "_ng", "_nb"))
    return _replace(df, F.col("_off") == 0, ("_off", "_hh", "_hs", "_hl", "_wheel"))


def _rgb() -> list[Column]:
    return [F.col(c) for c in "rgb"]


def _replace(df: DataFrame, verbatim: Column, drop: tuple[str, ...]) -> DataFrame:
    """Take the new channels except where the base stays verbatim."""
    df = df.withColumn("_same", verbatim)
    df = df.withColumns({c: F.when(F.col("_same"), F.col(c)).otherwise(F.col(f"_n{c}")) for c in "rgb"})
    return df.drop("_nr", "_ng", "_nb", "_same", *drop)


def hue_harmonies(bases: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Hue-rotation harmonies of every base: rows (..., type, ord, r, g, b)."""
    entries = [
        F.struct(F.lit(t).alias("type"), F.lit(i).alias("ord"), F.lit(float(off)).alias("offset"))
        for t in types or list(K.HARMONY_OFFSETS)
        for i, off in enumerate(K.HARMONY_OFFSETS[t])
    ]
    return rotate(bases.select("*", F.inline(F.array(*entries))), F.col("offset")).drop("offset")


def expanded_harmony(bases: DataFrame, kind: str, count: int) -> DataFrame:
    """``count`` slots: anchors first, then cycles of muted echoes that reuse the anchor hues.

    The anchors' hues are re-read from their rounded channels, as generated colours are.
    """
    offsets = K.HARMONY_OFFSETS[kind]
    n = len(offsets)
    if count < n:
        raise ValueError(f"count={count} too small for {kind} (min {n})")
    cycles = (count - 1) // n
    df = bases.withColumns({"_bs": kernel.hsv(*_rgb())[1], "_bv": kernel.hsv(*_rgb())[2]})
    df = df.withColumn("ord", _slots(count))
    turns = F.expr("array(" + ",".join(f"{float(x)!r}D" for x in offsets) + ")")
    df = rotate(df, F.get(turns, F.col("ord") % n))
    cycle = F.floor((F.col("ord") - n) / n) + 1
    df = kernel.staged(df, {"_f": kernel.lit(1) - cycle / float(cycles + 1), "_ah": kernel.hue(*_rgb())})
    value = F.greatest(kernel.lit(V_FLOOR), F.col("_bv") * F.col("_f"))
    df = kernel.with_hsv_bytes(df, F.col("_ah"), F.col("_bs") * F.col("_f"), value, ("_nr", "_ng", "_nb"))
    return _replace(df, F.col("ord") < n, ("_f", "_ah", "_bs", "_bv")).withColumn("type", F.lit(kind))


def analogous(bases: DataFrame, count: int = 3, step: float = 30.0) -> DataFrame:
    df = bases.withColumn("ord", _slots(count))
    return rotate(df, (F.col("ord") - (count - 1) / 2.0) * float(step)).withColumn("type", F.lit("analogous"))


def monochromatic(bases: DataFrame, count: int = 5) -> DataFrame:
    """Value / saturation ramp in HSV. Saturation walks off the base by 1/count a slot and bounces at the
    unit edges; value dips once, then runs away from the base side, between the floor and one.

    The bounce is a fold over the slot's steps (at most ``count`` of them).
    """
    step = 1.0 / count
    h, s, v = kernel.hsv(*_rgb())
    df = kernel.staged(bases, {"_h": h, "_s0": s, "_v0": v}).withColumn("ord", _slots(count))
    start = F.struct(F.col("_s0").alias("s"), kernel.lit(-1).alias("dir"))

    def walk(state: Column, _: Column) -> Column:
        ahead = state["s"] + state["dir"] * step
        out = (ahead < 0) | (ahead > 1)
        turned = F.when(out, -state["dir"]).otherwise(state["dir"])
        return F.struct((state["s"] + turned * step).alias("s"), turned.alias("dir"))

    steps = F.when(F.col("ord") > 0, F.sequence(F.lit(1), F.col("ord"))).otherwise(F.array().cast("array<int>"))
    sat = F.aggregate(steps, start, walk, lambda state: state["s"])
    side = F.when(F.col("_v0") >= 0.5, kernel.lit(-1)).otherwise(kernel.lit(1))
    value = F.when(F.col("ord") == 1, F.col("_v0") - step).otherwise(F.col("_v0") + side * step * F.col("ord"))
    df = df.withColumns({"_sat": sat, "_val": kernel.clamp(value, V_FLOOR, 1.0)})
    df = kernel.with_hsv_bytes(df, F.col("_h"), F.col("_sat"), F.col("_val"), ("_nr", "_ng", "_nb"))
    return _replace(df, F.col("ord") == 0, ("_h", "_s0", "_v0", "_sat", "_val")).withColumn("type", F.lit("monochromatic"))


def shades(bases: DataFrame, count: int = 5) -> DataFrame:
    """HSL lightness from the base down to 5 % in equal steps."""
    h, s, l = kernel.hsl(*_rgb())
    df = kernel.staged(bases, {"_h": h, "_hs": s, "_pct": l * 100.0}).withColumn("ord", _slots(count))
    light = (F.col("_pct") - (F.col("_pct") - 5.0) * F.col("ord") / float(max(count - 1, 1))) / 100.0
    df = kernel.with_hsl_bytes(df, F.col("_h"), F.col("_hs"), light, ("_nr", "_ng", "_nb"))
    return _replace(df, F.col("ord") == 0, ("_h", "_hs", "_pct")).withColumn("type", F.lit("shades"))


def generate(bases: DataFrame, kind: str, count: int = 0, step: float = 0.0) -> DataFrame:
    """Any harmony by canonical name; count 0 is the natural size, step 0 is 30 degrees."""
    if kind in K.HARMONY_OFFSETS:
        return expanded_harmony(bases, kind, count or len(K.HARMONY_OFFSETS[kind]))
    if kind == "analogous":
        return analogous(bases, count if count > 0 else 3, step or 30.0)
    if kind == "monochromatic":
        return monochromatic(bases, count if count > 0 else 5)
    if kind == "shades":
        return shades(bases, count if count > 0 else 5)
    raise ValueError(f"unknown harmony type {kind!r}")


def shade_scale(bases: DataFrame, key: str, count: int) -> DataFrame:
    """Monochromatic variants from light to dark with their scale labels."""
    labels = K.SHADE_LABELS.get(count, [100 * (i + 1) for i in range(count)])
    order = Window.partitionBy(key).orderBy(kernel.hsl_lightness(*_rgb()).desc(), "ord")
    ranked = monochromatic(bases, count).withColumn("pos", F.row_number().over(order) - 1)
    label = F.get(F.array(*[F.lit(x) for x in labels]), F.col("pos").cast("int"))
    return ranked.select(key, "pos", label.alias("label"), *"rgb")


# --- random palettes ----------------------------------------------------------------------------------------

DRAW_MOD = 2147483647


def draw(seed: Column, slot: Column | int, k: int) -> Column:
    """Repeatable draw in [0, 1) from (seed, slot, k): three multiply-and-reduce rounds, no state."""
    slot = F.lit(slot) if isinstance(slot, int) else slot
    x = (seed.cast("bigint") * 48271 + slot.cast("bigint") * 69621 + (k + 1) * 16807) % DRAW_MOD
    for _ in range(3):
        x = (x * 48271 + 11) % DRAW_MOD
    return x / float(DRAW_MOD)


def random_palettes(seeds: DataFrame, seed: str = "seed", count: int = K.PALETTE_SIZE) -> DataFrame:
    """Evenly spread hues around a random base, jittered by up to 10 degrees, S .5-.8, L .4-.7.

    Draws depend on the row's seed only, so the result does not change with partitioning.
    """
    if not 1 <= count <= K.MAX_PALETTE_SIZE:
        raise ValueError(f"a palette has 1 to {K.MAX_PALETTE_SIZE} colours, not {count}")
    n = count
    s, slot = F.col(seed), F.col("ord")
    df = seeds.withColumn("ord", _slots(n))
    h = draw(s, -1, 0) * 360.0 + slot * (360.0 / n) + draw(s, slot, 1) * 20.0 - 10.0
    return kernel.with_hsl_bytes(df, h, draw(s, slot, 2) * 0.30 + 0.50, draw(s, slot, 3) * 0.30 + 0.40)


def random_harmony(seeds: DataFrame, kind: str, count: int = 0, seed: str = "seed") -> DataFrame:
    """One random base per seed, then the harmony around it."""
    return generate(random_palettes(seeds, seed, 1).drop("ord"), kind, count)


def keep_locked(generated: DataFrame, stored: DataFrame) -> DataFrame:
    """Regenerated slots, except those locked in the stored palette; stored slots beyond the new size drop."""
    old = stored.select("palette_id", "ord", *[F.col(c).alias(f"_o{c}") for c in "rgb"], F.col("locked").alias("_locked"))
    df = generated.join(old, ["palette_id", "ord"], "left").withColumn("locked", F.coalesce("_locked", F.lit(False)))
    picked = [F.when(F.col("locked"), F.col(f"_o{c}")).otherwise(F.col(c)).alias(c) for c in "rgb"]
    return df.select("palette_id", "ord", *picked, "locked")
