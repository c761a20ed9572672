"""Shared plan-shaping helpers: lineage cuts, chunked ranking, hot-group-safe joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows of one image that may share a task in a pixel-level join or window.
TILE_ROWS = 1 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder named by ``spark.checkpoint.dir``; a scratch folder only on a local master."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tintlake-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that lost executors cost only a re-read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def chunked_offsets(df: DataFrame, group: list[str], bucket: str, weight: Column | None = None) -> DataFrame:
    """Rows (or weight) that precede each bucket of its group; one row per (group, bucket)."""
    total = F.sum(weight) if weight is not None else F.count(F.lit(1))
    sizes = df.groupBy(*group, bucket).agg(total.alias("_size"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    return sizes.select(
        *group, bucket, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(whole).alias("_total")
    )


def dense_position(df: DataFrame, group: list[str], bucket: Column, order: list, name: str, total: str | None = None) -> DataFrame:
    """0-based position of each row in its group, and the group's row count as ``total`` if named.

    ``bucket`` must be a monotone function of the first ordering term. Only one bucket of a group is
    ever sorted in one task: the group total is reached through per-bucket counts, so a group that
    holds a large share of all rows is spread over its buckets.
    """
    marked = df.withColumn("_bucket", bucket)
    offsets = chunked_offsets(marked, group, "_bucket")
    local = Window.partitionBy(*group, "_bucket").orderBy(*order)
    placed = (
        marked.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, [*group, "_bucket"])
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_bucket", "_local", "_before")
    )
    return placed.withColumnRenamed("_total", total) if total else placed.drop("_total")


def running_weight(df: DataFrame, group: list[str], key: str, weight: str, bucket: Column, name: str, total: str | None = None) -> DataFrame:
    """Weight of all rows of the group with a smaller ``key`` (keys unique per group), bucket by bucket; the
    group's whole weight as ``total`` if named."""
    marked = df.withColumn("_bucket", bucket)
    offsets = chunked_offsets(marked, group, "_bucket", F.col(weight))
    before = Window.partitionBy(*group, "_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = (
        marked.withColumn("_local", F.coalesce(F.sum(weight).over(before), F.lit(0)))
        .join(offsets, [*group, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_bucket", "_local", "_before")
    )
    return summed.withColumnRenamed("_total", total) if total else summed.drop("_total")


def tile(idx: Column | str) -> Column:
    """Tile number of a raster index: at most ``TILE_ROWS`` pixels of an image share one."""
    col = F.col(idx) if isinstance(idx, str) else idx
    return F.floor(col / F.lit(TILE_ROWS)).cast("bigint")


def with_image_totals(pixels: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Add per-image sums to every pixel row.

    Sums are combined per (image, tile), added up over the few tiles of an image, and joined back on
    (image, tile), so a huge image stays spread over its tiles.
    """
    tiled = pixels.withColumn("_tile", tile("idx"))
    parts = tiled.groupBy("image_id", "_tile").agg(*[v.alias(n) for n, v in totals.items()])
    whole = Window.partitionBy("image_id")
    sums = parts.select("image_id", "_tile", *[F.sum(n).over(whole).alias(n) for n in totals])
    return tiled.join(sums, ["image_id", "_tile"]).drop("_tile")


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by key into twice the session's shuffle width, for compute-heavy grouped work.

    An explicit width is not merged into fewer partitions for small data, and as it differs from the width of
    implicit shuffles it is not dropped as a repeat of one.
    """
    width = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *keys)


def join_image_facts(pixels: DataFrame, facts: DataFrame, pixel_count: str, how: str = "inner") -> DataFrame:
    """Join per-image facts to pixels on (image_id, tile of idx).

    Each facts row is repeated once per tile of its image (one copy for all but huge images), so no
    join partition has to hold more than ``TILE_ROWS`` pixels of one image.
    """
    tiles = F.sequence(F.lit(0).cast("bigint"), tile(F.greatest(F.col(pixel_count) - 1, F.lit(0))))
    spread = facts.withColumn("_tile", F.explode(tiles))
    return pixels.withColumn("_tile", tile("idx")).join(spread, ["image_id", "_tile"], how).drop("_tile")


# Distinct colours of one image that may share a task: red is split into 16 ranges of 2^20 colours each.
COLOR_SPLITS = 16


def join_color_facts(colors: DataFrame, facts: DataFrame, how: str = "inner", key: str = "image_id") -> DataFrame:
    """Join per-image rows to the colours of an image, split by the top bits of red.

    An image can hold up to 2^24 distinct colours; its facts are repeated per split so that no join
    partition holds more than 2^20 of them.
    """
    spread = facts.withColumn("_split", F.explode(F.sequence(F.lit(0), F.lit(COLOR_SPLITS - 1))))
    return colors.withColumn("_split", F.shiftright("r", 4)).join(spread, [key, "_split"], how).drop("_split")


SALTS = 32


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], spread: Column, how: str = "inner", many_facts: bool = False) -> DataFrame:
    """Join one fact row per key to many rows where one key may own a large share of them: ``spread`` cuts the
    rows of a key into ``SALTS`` parts and the facts are repeated per part. ``many_facts`` keeps them from being broadcast,
    as the planner's estimate knows nothing of the repeats."""
    many = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    many = many.hint("merge") if many_facts else many
    return rows.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int")).join(many, [*keys, "_salt"], how).drop("_salt")
