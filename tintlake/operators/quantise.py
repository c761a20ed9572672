"""Deterministic palette extraction for all images at once: popularity, median cut, Wu, octree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import kernel
from ..runtime import cut, join_color_facts, running_weight
from .clusters import octree_fold
from .pixels import CHANNELS, bin_sums, color_counts, histogram, top_k


def _mean(c: str):
    return F.floor(F.col(f"s{c}") / F.col("n")).cast("int").alias(c)


def with_share(palette: DataFrame, group: str = "image_id") -> DataFrame:
    """Add ``freq``: share of the kept weight. Runs over at most one palette per window."""
    return palette.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def popularity(pixels: DataFrame, k: int = K.PALETTE_SIZE, bits: int = 5, group: str = "image_id") -> DataFrame:
    """k fullest colour bins, earliest key on ties; shares are over the kept bins."""
    return fullest_bins(histogram(pixels, bits, (group,)), k, group)


def fullest_bins(hist: DataFrame, k: int, group: str = "image_id") -> DataFrame:
    """k fullest bins of a histogram, earliest key on ties, with their share of the kept bins."""
    return with_share(top_k(hist, [group], [F.col("n").desc(), "key"], k), group).select(group, "ord", *CHANNELS, "n", "freq")


# --- median cut -----------------------------------------------------------------------------------------------


def median_cut(pixels: DataFrame, k: int = K.PALETTE_SIZE) -> DataFrame:
    """Split the largest bucket at its middle pixel along its widest channel until k buckets exist.

    Works on the exact-colour histogram with a bucket path per colour ('0' / '1' per split, so paths sort in
    bucket order). A split needs the running pixel count along (axis, r, g, b); a colour that straddles the
    middle is divided between both halves. Every round handles one split of every image and is written out.
    """
    state = cut(color_counts(pixels).withColumn("path", F.lit("")))
    for _ in range(k - 1):
        state = cut(_split_largest(state))
    sums = [F.sum(F.col(c) * F.col("n")).alias(f"s{c}") for c in CHANNELS]
    out = state.groupBy("image_id", "path").agg(F.sum("n").alias("n"), *sums)
    order = Window.partitionBy("image_id").orderBy("path")  # at most k rows
    out = out.withColumn("ord", F.row_number().over(order) - 1)
    return with_share(out).select("image_id", "ord", *[_mean(c) for c in CHANNELS], "n", "freq")


def _split_largest(state: DataFrame) -> DataFrame:
    spans = [(F.max(c) - F.min(c)).alias(f"w{c}") for c in CHANNELS]
    stats = state.groupBy("image_id", "path").agg(F.sum("n").alias("size"), *spans).filter("size > 1")
    widest = F.greatest("wr", "wg", "wb")
    axis = F.when(F.col("wr") == widest, 0).when(F.col("wg") == widest, 1).otherwise(2)
    pick = stats.groupBy("image_id").agg(
        F.min_by(F.struct("path", "size", axis.alias("axis")), F.struct(-F.col("size"), "path")).alias("cut")
    )
    flagged = join_color_facts(state, pick, "left")
    flagged = flagged.withColumn("hit", F.coalesce(F.col("cut.path") == F.col("path"), F.lit(False)))
    main = F.element_at(F.array(*CHANNELS), F.col("cut.axis") + 1).cast("bigint")
    packed = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    hit = flagged.filter("hit").withColumn("key", main * (1 << 24) + packed)
    hit = running_weight(hit, ["image_id"], "key", "n", F.floor(F.col("key") / (1 << 20)), "before")
    middle = F.floor(F.col("cut.size") / 2)
    left = F.least(F.greatest(middle - F.col("before"), F.lit(0)), F.col("n")).cast("bigint")
    halves = F.array(
        F.struct(F.concat("path", F.lit("0")).alias("path"), left.alias("n")),
        F.struct(F.concat("path", F.lit("1")).alias("path"), (F.col("n") - left).alias("n")),
    )
    split = hit.select("image_id", *CHANNELS, halves.alias("h")).select("image_id", *CHANNELS, F.inline("h")).filter("n > 0")
    return flagged.filter("not hit").select("image_id", *CHANNELS, "path", "n").unionByName(split)


# --- Wu -------------------------------------------------------------------------------------------------------


def wu(pixels: DataFrame, k: int = K.PALETTE_SIZE) -> DataFrame:
    """Variance-minimising cuts on the 5-bit histogram (at most 32768 bins an image).

    Per round the box of largest residual variance is cut where the between-part energy is highest; the
    moments on each side come from cumulative sums over at most 32 positions per axis. A box of one bin
    cannot be cut and is passed over.
    """
    bins = bin_sums(pixels, 5)
    place = {"p0": F.shiftright("key", 10), "p1": F.shiftright("key", 5).bitwiseAND(31), "p2": F.col("key").bitwiseAND(31)}
    state = cut(bins.withColumns(place).withColumn("box", F.lit(0)))
    for _ in range(k - 1):
        state = cut(_cut_box(state))
    out = state.groupBy("image_id", "box").agg(*[F.sum(c).alias(c) for c in ("n", "sr", "sg", "sb")])
    out = out.withColumnRenamed("box", "ord")
    return with_share(out).select("image_id", "ord", *[_mean(c) for c in CHANNELS], "n", "freq")


SUMS = ["n", "sr", "sg", "sb"]


def _energy(n, sums):
    total = kernel.lit(0)
    for s in sums:
        total = total + s.cast("double") * s.cast("double")
    return total / n.cast("double")


def _cut_box(state: DataFrame) -> DataFrame:
    boxes = state.groupBy("image_id", "box").agg(*[F.sum(c).alias(c) for c in [*SUMS, "sq"]], F.count("*").alias("bins"))
    residual = F.col("sq").cast("double") - _energy(F.col("n"), [F.col(c) for c in SUMS[1:]])
    cuttable = (F.col("bins") > 1) & (F.col("residual") > 0)
    boxes = boxes.withColumn("residual", residual)
    pick = boxes.groupBy("image_id").agg(
        (F.max("box") + 1).alias("fresh"),
        F.min_by(
            F.struct("box", *[F.col(c).alias(f"w{c}") for c in SUMS]), F.when(cuttable, F.struct(-F.col("residual"), F.col("box")))
        ).alias("pick"),
        F.count_if(cuttable).alias("cuttable"),
    )
    pick = pick.filter("cuttable > 0").select("image_id", "fresh", "pick.*")
    inside = state.join(pick, ["image_id", "box"])
    axes = F.array(*[F.struct(F.lit(i).alias("axis"), F.col(f"p{i}").alias("pos")) for i in range(3)])
    whole = [f"w{c}" for c in SUMS]
    edges = inside.select("image_id", "box", "fresh", *whole, *SUMS, F.inline(axes))
    edges = edges.groupBy("image_id", "box", "fresh", *whole, "axis", "pos").agg(*[F.sum(c).alias(c) for c in SUMS])
    upto = Window.partitionBy("image_id", "axis").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.withColumns({f"c{c}": F.sum(c).over(upto) for c in SUMS}).filter("cn < wn")
    low = _energy(F.col("cn"), [F.col(f"c{c}") for c in SUMS[1:]])
    high = _energy(F.col("wn") - F.col("cn"), [F.col(f"w{c}") - F.col(f"c{c}") for c in SUMS[1:]])
    edges = edges.withColumn("gain", low + high)
    best = edges.groupBy("image_id").agg(
        F.min_by(F.struct("box", "fresh", "axis", "pos"), F.struct(-F.col("gain"), "axis", "pos")).alias("best")
    )
    moved = state.join(best, "image_id", "left")
    at = F.element_at(F.array("p0", "p1", "p2"), F.col("best.axis") + 1)
    box = F.when((F.col("best.box") == F.col("box")) & (at > F.col("best.pos")), F.col("best.fresh")).otherwise(F.col("box"))
    return moved.select("image_id", "key", *SUMS, "sq", "p0", "p1", "p2", box.alias("box"))


# --- octree ----------------------------------------------------------------------------------------------------


def _path() -> Column:
    """Interleaved bits of r, g, b: the colour's path in the octree, in child order."""
    code = F.lit(0)
    for bit in range(7, -1, -1):
        digit = sum((F.shiftright(c, bit).bitwiseAND(1) * w for c, w in zip(CHANNELS, (4, 2, 1))), F.lit(0))
        code = code * 8 + digit
    return code


def _node(depth: Column) -> Column:
    return F.floor(F.col("path") / F.pow(F.lit(8), 8 - depth)).cast("int")


def octree(pixels: DataFrame, k: int = K.PALETTE_SIZE) -> DataFrame:
    """Octree quantisation.

    Collapsing whole levels bottom-up is just grouping by a shorter prefix, as long as at least k nodes stay.
    So the shallowest depth with k or more nodes is found from node counts, colours are grouped at that depth,
    and only the last, budgeted collapses run on the fewer than 8k leaves that are left (see ``octree_fold``).
    """
    hist = cut(color_counts(pixels).withColumn("path", _path()))
    depths = F.explode(F.sequence(F.lit(1), F.lit(8)))
    nodes = hist.select("image_id", "path", depths.alias("depth")).select("image_id", "depth", _node(F.col("depth")).alias("node"))
    sizes = nodes.distinct().groupBy("image_id", "depth").agg(F.count("*").alias("nodes"))
    level = sizes.groupBy("image_id").agg(F.coalesce(F.min(F.when(F.col("nodes") >= k, F.col("depth"))), F.lit(8)).alias("depth"))
    placed = join_color_facts(hist, level).withColumn("node", _node(F.col("depth")))
    sums = [F.sum(F.col(c) * F.col("n")).alias(f"s{c}") for c in CHANNELS]
    leaves = placed.groupBy("image_id", "depth", "node").agg(F.sum("n").alias("n"), *sums)
    return with_share(octree_fold(leaves, k)).select("image_id", "ord", *[_mean(c) for c in CHANNELS], "n", "freq")


# --- shared tail --------------------------------------------------------------------------------------------------


POSITION_SPAN = 1 << 44  # above any raster position


def annotate(palette: DataFrame, pixels: DataFrame, images: DataFrame) -> DataFrame:
    """Add the pixel nearest each palette colour (first in raster order) as normalised centre coordinates.

    Pixels shrink to distinct colours with their first position before they meet the palette. Fully transparent
    pixels count as black.
    """
    shown = pixels.select("image_id", "idx", *[F.when(F.col("a") == 0, 0).otherwise(F.col(c)).alias(c) for c in CHANNELS])
    first = shown.groupBy("image_id", *CHANNELS).agg(F.min("idx").alias("idx"))
    targets = palette.select("image_id", "ord", *[F.col(c).alias(f"p{c}") for c in CHANNELS])
    near = join_color_facts(first, targets)
    d = sum(((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in CHANNELS), F.lit(0))
    # distance (below 2^18) and raster position share one integer, so the minimum runs as a hash aggregate
    packed = F.min(d.cast("bigint") * POSITION_SPAN + F.col("idx"))
    near = near.groupBy("image_id", "ord").agg((packed % POSITION_SPAN).alias("_idx"))
    placed = palette.join(near, ["image_id", "ord"], "left").join(images.select("image_id", "w", "h"), "image_id")
    x, y = F.col("_idx") % F.col("w"), F.floor(F.col("_idx") / F.col("w"))
    return placed.withColumns({"src_x": (x + 0.5) / F.col("w"), "src_y": (y + 0.5) / F.col("h")}).drop("_idx", "w", "h")


def provenance(stats: DataFrame, images: DataFrame, method: str, params: dict[str, str]) -> DataFrame:
    """Per-image record of how its palette was made."""
    pairs = F.create_map(*[F.lit(x) for kv in sorted(params.items()) for x in kv])
    return stats.join(images.select("image_id", "w", "h"), "image_id").select(
        "image_id", F.lit(method).alias("method"), pairs.alias("params"), "w", "h",
        (F.col("n_total") > F.col("n_valid")).alias("has_masked"), "n_total", "n_valid",
    )


def batch(pixels: DataFrame, sources: DataFrame, palette: DataFrame, key: str = "image_id") -> DataFrame:
    """One row per requested source in input order: its palette, or why it has none."""
    slots = F.array_sort(F.collect_list(F.struct("ord", *CHANNELS)))  # at most one palette long
    made = palette.groupBy(key).agg(slots.alias("palette"))
    seen = pixels.groupBy(key).agg(F.count("*").alias("_n"))
    joined = sources.join(seen, key, "left").join(made, key, "left")
    error = F.when(F.col("_n").isNull(), "source not readable").when(F.col("palette").isNull(), "no pixels left after alpha mask")
    return joined.withColumn("error", error).drop("_n")


def require_success(batch_rows: DataFrame) -> DataFrame:
    """Fail when every source failed; otherwise pass the rows on."""
    if batch_rows.filter(F.col("error").isNull()).isEmpty():
        raise ValueError("all sources failed")
    return batch_rows
