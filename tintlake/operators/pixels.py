"""Pixel-table jobs: masking, statistics, sampling, block down-sampling, point look-up, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..runtime import dense_position, join_image_facts, salted_join, tile

CHANNELS = ["r", "g", "b"]


def opaque(pixels: DataFrame, threshold: int = 1) -> DataFrame:
    """Drop pixels whose alpha is below the threshold; the filter reaches the scan."""
    return pixels.filter(F.col("a") >= threshold)


def pixel_stats(pixels: DataFrame, threshold: int = 1) -> DataFrame:
    """Total and valid pixels per image; an image without valid pixels carries an error."""
    return (
        pixels.groupBy("image_id")
        .agg(F.count("*").alias("n_total"), F.count_if(F.col("a") >= threshold).alias("n_valid"))
        .withColumn("error", F.when(F.col("n_valid") == 0, "no pixels left after alpha mask"))
    )


def subsample(pixels: DataFrame, cap: int) -> DataFrame:
    """Positional sample: every stride-th row of an image in raster order, at most ``cap`` of them.

    An image with at most ``cap`` rows is kept whole. Positions are found tile by tile, so a huge image
    is ranked by many tasks.
    """
    ranked = dense_position(pixels, ["image_id"], tile("idx"), ["idx"], "pos", total="_n")
    ranked = ranked.withColumn("_stride", F.greatest(F.floor(F.col("_n") / cap), F.lit(1)))
    step = F.floor(F.col("pos") / F.col("_stride"))
    keep = (F.col("_n") <= cap) | ((F.col("pos") % F.col("_stride") == 0) & (step < cap))
    return ranked.filter(keep).drop("_n", "_stride")


def target_size(w: Column, h: Column, side: int) -> tuple[Column, Column]:
    """Longest side at most ``side``, aspect by integer division, at least one pixel, never larger."""
    if side <= 0:
        return w, h
    shrink = F.greatest(w, h) > side
    nw = F.when(w >= h, F.lit(side)).otherwise(F.greatest(F.floor(w * side / h), F.lit(1)))
    nh = F.when(w >= h, F.greatest(F.floor(h * side / w), F.lit(1))).otherwise(F.lit(side))
    return F.when(shrink, nw).otherwise(w).cast("int"), F.when(shrink, nh).otherwise(h).cast("int")


def downsample(pixels: DataFrame, images: DataFrame, side: int = K.RESIZE_SIDE) -> DataFrame:
    """Block mean per target cell (floor of sum over count), keyed by target coordinates."""
    nw, nh = target_size(F.col("w"), F.col("h"), side)
    sized = images.select("image_id", "n_total", "w", "h").withColumns({"nw": nw, "nh": nh})
    cells = join_image_facts(pixels, sized, "n_total").withColumns(
        {"bx": F.floor(F.col("x") * F.col("nw") / F.col("w")).cast("int"), "by": F.floor(F.col("y") * F.col("nh") / F.col("h")).cast("int")}
    )
    means = [F.floor(F.sum(c) / F.count("*")).cast("int").alias(c) for c in [*CHANNELS, "a"]]
    out = cells.groupBy("image_id", "nw", F.col("bx").alias("x"), F.col("by").alias("y")).agg(*means)
    return out.select("image_id", (F.col("y").cast("bigint") * F.col("nw") + F.col("x")).alias("idx"), "x", "y", *CHANNELS, "a")


def pixel_at_points(points: DataFrame, pixels: DataFrame, images: DataFrame) -> DataFrame:
    """Pixel under each normalised point; coordinates are floored and clamped to the image."""
    placed = salted_join(points, images.select("image_id", "w", "h"), ["image_id"], F.xxhash64("nx", "ny"))

    def snap(v: str, size: str) -> Column:
        return F.least(F.greatest(F.floor(F.col(v) * F.col(size)), F.lit(0)), F.col(size) - 1).cast("int")

    placed = placed.withColumns({"x": snap("nx", "w"), "y": snap("ny", "h")}).drop("w", "h")
    return placed.join(pixels.select("image_id", "x", "y", *CHANNELS, "a"), ["image_id", "x", "y"], "left")


def color_counts(pixels: DataFrame) -> DataFrame:
    """Exact-colour histogram (image_id, r, g, b, n): map-side combined, keyed by image and colour."""
    return pixels.groupBy("image_id", *CHANNELS).agg(F.count("*").alias("n"))


def bin_key(bits: int) -> Column:
    bits = min(max(bits, 1), 8)
    parts = [F.shiftright(F.col(c), 8 - bits) for c in CHANNELS]
    return F.shiftleft(parts[0], 2 * bits).bitwiseOR(F.shiftleft(parts[1], bits)).bitwiseOR(parts[2])


def bin_sums(pixels: DataFrame, bits: int = 5, group: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Per group and colour bin: n and channel sums, all mergeable."""
    keyed = pixels.withColumn("key", bin_key(bits))
    sums = [F.sum(c).alias(f"s{c}") for c in CHANNELS]
    squares = sum((F.col(c).cast("bigint") * F.col(c) for c in CHANNELS), F.lit(0).cast("bigint"))
    return keyed.groupBy(*group, "key").agg(F.count("*").alias("n"), *sums, F.sum(squares).alias("sq"))


def histogram(pixels: DataFrame, bits: int = 5, group: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """RGB binning: count and floor-mean colour per bin."""
    return bin_means(bin_sums(pixels, bits, group), group)


def bin_means(sums: DataFrame, group: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Count and floor-mean colour of bins given by their sums."""
    means = [F.floor(F.col(f"s{c}") / F.col("n")).cast("int").alias(c) for c in CHANNELS]
    return sums.select(*group, "key", "n", *means)


def top_k(df: DataFrame, group: list[str], order: list, k: int, rank: str = "ord") -> DataFrame:
    """First k rows per group; Spark keeps only k rows per task before the shuffle."""
    # the filter has to name the row number itself for Spark to push the limit below the shuffle
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)
    return ranked.withColumn(rank, F.col(rank) - 1)
