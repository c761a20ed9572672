"""Heavy colours from sketches: each part of a corpus is read once, its sketch kept, and sketches merged as needed.

A sketch (Spark's frequent-items sketch) holds a bounded number of colour bins whatever it has read. Sketches of parts
(days, shards, images) can be written as a table and merged later into any grouping without reading pixels again. After
any merge an estimate differs from the exact count by at most ``3.5 / tracked`` of the pixels read, the ``error`` given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pixels import CHANNELS, bin_key, top_k

TRACKED = 4096


def sketch_colors(pixels: DataFrame, group: list[str], tracked: int = TRACKED, bits: int = 5) -> DataFrame:
    """(``group``, sketch, n): one sketch a group over its colour bins; pixels with a null channel take no part."""
    keyed = pixels.withColumn("_key", bin_key(bits)).filter("_key is not null")
    return keyed.groupBy(*group).agg(F.expr(f"approx_top_k_accumulate(_key, {int(tracked)})").alias("sketch"), F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, group: list[str], tracked: int = TRACKED) -> DataFrame:
    """The sketches of a coarser grouping (all of the same ``tracked``), with the pixels they have read."""
    return sketches.groupBy(*group).agg(F.expr(f"approx_top_k_combine(sketch, {int(tracked)})").alias("sketch"), F.sum("n").alias("n"))


def heavy_colors(sketches: DataFrame, group: list[str], k: int, tracked: int = TRACKED, bits: int = 5) -> DataFrame:
    """(``group``, ord, key, r, g, b, estimate, error, n): at most k bins of every sketch by estimate, then key.

    The colour is the middle of its bin. Bins whose count does not rise above the sketch's own error are left out.
    """
    found = sketches.select(*group, "n", F.explode(F.expr(f"approx_top_k_estimate(sketch, {int(tracked)})")).alias("_top"))
    error = F.ceil(F.lit(3.5) * F.col("n") / tracked).alias("error")
    found = found.select(*group, F.col("_top.item").alias("key"), F.col("_top.count").alias("estimate"), error, "n")
    out = top_k(found, group, [F.col("estimate").desc(), "key"], k)
    return out.select(*group, "ord", "key", *_middle(bits), "estimate", "error", "n")


def _middle(bits: int) -> list[Column]:
    step, mask = 8 - bits, (1 << bits) - 1
    half = (1 << step) >> 1
    return [(F.shiftleft(F.shiftright("key", (2 - i) * bits).bitwiseAND(F.lit(mask)), step) + half).cast("int").alias(c) for i, c in enumerate(CHANNELS)]
