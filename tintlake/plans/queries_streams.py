"""Colour bins that grow: the pixel table as arriving files, and as sketches of its parts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import pixels as px
from ..operators import sketches as sk
from ..runtime import ensure_checkpoint_dir
from ..streaming import histograms as sh
from . import derived as d
from .derived import sql
from .queries_extract import _V, _bins, _popular, shown, valid
from .registry import query

FILES_PER_BATCH = 64


def _streamed(spark, sf) -> str:
    """Folder of the state after the whole pixel table has passed."""
    rows = d.table(spark, sf, "lineitem")
    # a plain path of a stream has to be a folder; a pattern may also match one file
    arriving = sh.arriving(spark, f"{sf}/lineitem[.]parquet", rows.schema, FILES_PER_BATCH)
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    sh.stream_bins(px.opaque(d.ints(arriving, **d.PIXEL_COLS)), folder).awaitTermination()
    return folder


@query("c1_streamed_histogram", sql("pixels", f"{_V} {_bins(5)}"))
def streamed_histogram(spark, sf):
    return sh.streamed_histogram(spark, _streamed(spark, sf))


@query("c2_streamed_popularity", sql("pixels", f"{_V} {_popular()}"))
def streamed_popularity(spark, sf):
    return shown(sh.streamed_popularity(spark, _streamed(spark, sf), K.PALETTE_SIZE))


TRACKED = 64


@query("c2_sketch_bounds", sql("pixels", f"{_V} select image_id, count(*) as n, true as within from px group by image_id"))
def sketch_bounds(spark, sf):
    """Per image, whether all estimates of its merged sketch lie within the stated error of the exact counts."""
    pixels = valid(spark, sf)
    parts = sk.sketch_colors(pixels.withColumn("part", F.col("a") % 4), ["image_id", "part"], TRACKED)
    merged = sk.merge_sketches(parts, ["image_id"], TRACKED)
    heavy = sk.heavy_colors(merged, ["image_id"], K.MAX_PALETTE_SIZE, TRACKED).drop("n")
    counts = px.bin_sums(pixels).select("image_id", "key", F.col("n").alias("exact"))
    near = heavy.join(counts, ["image_id", "key"], "left").select("image_id", (F.abs(F.col("estimate") - F.coalesce("exact", F.lit(0))) <= F.col("error")).alias("near"))
    held = near.groupBy("image_id").agg(F.every("near").alias("within"))
    return merged.join(held, "image_id", "left").select("image_id", "n", F.coalesce("within", F.lit(True)).alias("within"))
