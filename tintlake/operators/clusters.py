"""Iterative palette extraction: k-means variants, density clusters, nearest-pair merges.

Pixels fold to distinct colours or 5-bit bins; k-means rounds are joins and aggregates over blocks of the points of all
images at once, density labels over the bins. Small numpy helpers meet bounded pieces only: a block of points, the few
clusters of an image for nearest-pair merges, and the last leaves of its octree.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import kernel
from ..functions.numeric import FEATURES, SUMS, block_of, density_labels, distances, farthest_of_blocks, labelled, merge_closest, oklab_of, settled_points, sums_of_blocks
from ..runtime import cut, salted_join, spread_by, with_image_totals
from .pixels import CHANNELS, histogram, top_k

# --- rounds of centres ----------------------------------------------------------------------------------------------


# Rounds of centres per lineage cut; at a cut, keys whose last round moved nothing are set aside.
ROUNDS_PER_CUT = 5
# Centres of all keys, in bytes, up to which they are sent to every executor.
BROADCAST_BYTES = 16 << 20
# Points that are packed into one block.
BLOCK_POINTS = 1 << 16

_CENTRE = "struct<f0: double, f1: double, f2: double>"


def _near(centre: Column) -> Column:
    return sum(((F.col(f) - centre[f]) * (F.col(f) - centre[f]) for f in FEATURES), F.lit(0.0))


def laid_out(points: DataFrame, key: str) -> DataFrame:
    """Points with the number of parts of their key (``splits``, of about ``BLOCK_POINTS`` points) and their own part
    (``split``), those of one part side by side."""
    splits = points.groupBy(key).agg(F.ceil(F.count("*") / BLOCK_POINTS).cast("int").alias("splits"))
    placed = salted_join(points, splits, [key], F.xxhash64("pos"))
    placed = placed.withColumn("split", F.pmod(F.xxhash64("pos", F.lit(1)), F.col("splits")).cast("int"))
    return spread_by(placed, key, "split")


def packed_points(laid: DataFrame, key: str) -> DataFrame:
    """One row a part (key, split, f, w, pos) with the raw values of its points: a round costs a row a part, and a key
    of any size is spread over its parts."""
    points = laid.select(key, "split", *FEATURES, F.col("w").cast("double"), F.col("pos").cast("bigint"))
    kind = laid.schema[key].dataType.simpleString()
    return points.groupBy(key, "split").applyInArrow(block_of, f"{key} {kind}, split int, f binary, w binary, pos binary")


def _meeting(blocks: DataFrame, state: DataFrame, key: str, small: bool) -> DataFrame:
    """Blocks with their key's state: the one join of a round."""
    if small:
        return blocks.join(F.broadcast(state), key)
    return salted_join(blocks, state, [key], F.col("split"))


def seeded(blocks: DataFrame, state: DataFrame, key: str, small: bool) -> DataFrame:
    """States (key, centres) with one more centre: the point of greatest weight times squared distance to the nearest."""
    farthest = F.arrow_udf(farthest_of_blocks, "struct<rank: bigint, f0: double, f1: double, f2: double>")
    met = _meeting(blocks, state, key, small).select(key, "centres", farthest("f", "w", "pos", "centres").alias("far"))
    found = met.groupBy(key).agg(F.max("far.rank").alias("top"), F.max_by("far", "far.rank").alias("far"), F.first("centres").alias("centres"))
    spot = F.array(F.struct(*[F.col(f"far.{f}").alias(f) for f in FEATURES]))
    return found.select(key, F.when(F.col("top").isNotNull(), F.concat("centres", spot)).otherwise(F.col("centres")).alias("centres"))


def moved(blocks: DataFrame, state: DataFrame, key: str, small: bool) -> DataFrame:
    """States (key, centres, lead, moved) after one round. The old centres and the lead travel with the sums, so the
    old state is used once."""
    met = _meeting(blocks, state.select(key, "centres", "lead"), key, small)
    block_sums = F.arrow_udf(sums_of_blocks, "array<struct<s0: double, s1: double, s2: double, sw: double>>")
    sums = met.select(key, "lead", "centres", F.posexplode(block_sums("f", "w", "pos", "centres")).alias("c", "s"))
    per = sums.select(key, "c", "lead", F.col("centres")[F.col("c")].alias("old"), "s.*")
    flat = [F.col(f"{x}.{f}").alias(f"{x}_{f}") for x in ("lead", "old") for f in FEATURES]
    kept = [F.first(f"{x}_{f}").alias(f"{x}_{f}") for x in ("lead", "old") for f in FEATURES]
    added = per.select(key, "c", *flat, *SUMS).groupBy(key, "c").agg(*[F.sum(s).alias(s) for s in SUMS], *kept)
    new = [F.when(F.col("sw") > 0, F.round(F.col(s) / F.col("sw"), 6)).otherwise(F.col(f"lead_{f}")).alias(f) for s, f in zip(SUMS, FEATURES)]
    spots = added.select(key, "c", F.struct(*new).alias("new"), *[F.struct(*[F.col(f"{x}_{f}").alias(f) for f in FEATURES]).alias(x) for x in ("lead", "old")])
    slots = F.transform(F.array_sort(F.collect_list(F.struct("c", "new"))), lambda x: x["new"])  # one a centre
    return spots.groupBy(key).agg(slots.alias("centres"), F.first("lead").alias("lead"), F.bool_or(F.col("new") != F.col("old")).alias("moved"))


def cluster_points(points: DataFrame, k: int | str, rounds: int = K.LLOYD_ROUNDS, key: str = "image_id") -> DataFrame:
    """Lloyd's algorithm for all keys at once: add ``c`` to points (key, f0..f2, w, pos), ``pos`` unique in its key.

    Seeds: the heaviest point, then each time the point of greatest weight times squared distance to the nearest seed.
    Then ``rounds`` rounds, fewer for keys where nothing moves any more; a cluster without points restarts at the
    heaviest point. A key of at most ``BLOCK_POINTS`` points is brought to rest and labelled where its points meet, one
    key at a time; the points of larger keys are packed into blocks and go through rounds of all their blocks together
    (``spread_rounds``), with the same result. ``k`` is a number or names a column that is constant per key.
    """
    points = cut(points.withColumns({f: F.round(F.col(f), 6) for f in FEATURES}))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema) + ", c bigint"
    # at most one key for so many points
    many = cut(points.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK_POINTS).select(key))
    spread = not many.isEmpty()
    small = points.join(F.broadcast(many), key, "left_anti") if spread else points
    found = spread_by(small, key).groupBy(key).applyInArrow(settled_points(rounds, k), kinds)
    if not spread:
        return found
    laid = cut(laid_out(points.join(F.broadcast(many), key, "left_semi"), key))
    wanted = cut(laid.groupBy(key).agg(F.first(k).alias("k"))) if isinstance(k, str) else k
    centres = spread_rounds(cut(packed_points(laid, key)), wanted, rounds, key).join(laid.select(key, "splits").distinct(), key)
    parts = centres.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).select(key, "split", "centres")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in laid.schema) + ", c bigint"
    large = laid.groupBy(key, "split").cogroup(spread_by(parts, key, "split").groupBy(key, "split")).applyInArrow(labelled, kinds)
    return found.unionByName(large.drop("split", "splits"))


def _small(state: DataFrame, k: int) -> bool:
    return state.count() * (k + 1) * 40 <= BROADCAST_BYTES


def spread_rounds(blocks: DataFrame, k: int | DataFrame, rounds: int, key: str) -> DataFrame:
    """States (key, centres) of keys of any number of blocks; ``k`` is a number or rows (key, k).

    A key's state is an array of at most ``k`` centres; states meet the blocks by a broadcast while all of them are
    small (keys times ``k``), else by a salted join. A round is one join, a sum per block and centre, and aggregates of
    these sums; the state is cut every few rounds, and keys at rest are set aside.
    """
    state = cut(blocks.select(key).distinct().withColumn("centres", F.array().cast(f"array<{_CENTRE}>")))
    most = k if isinstance(k, int) else k.agg(F.max("k")).first()[0]
    small = _small(state, most)
    for step in range(most):
        state = seeded(blocks, state, key, small)
        if (step + 1) % ROUNDS_PER_CUT == 0:
            state = cut(state)
    if not isinstance(k, int):  # the seeds for fewer centres are the first of those for more
        state = state.join(k, key).select(key, F.slice("centres", F.lit(1), F.col("k")).alias("centres"))
    state = cut(state.select(key, "centres", F.element_at("centres", 1).alias("lead"), F.lit(True).alias("moved")))
    settled = []
    for step in range(1, rounds + 1):
        state = moved(blocks, state, key, small)
        if step % ROUNDS_PER_CUT == 0 or step == rounds:
            state = cut(state)
            settled.append(state.filter(~F.col("moved")))
            state = state.filter("moved")
            if state.isEmpty():
                break
    return reduce(DataFrame.unionByName, settled, state)


# --- grouped application --------------------------------------------------------------------------------------------


def merge_clusters(clusters: DataFrame, radius: float | str, floor: int | str, key: str = "image_id") -> DataFrame:
    """Nearest-pair merge of (key, c, f0..f2, n, s, ...), a few times k clusters an image; radius inf merges down
    to floor. Further columns are constant per image and are kept; ``radius`` and ``floor`` may name two of them."""
    carried = [c for c in clusters.columns if c not in ("c", *FEATURES, "n", "s")]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(np.argsort(rows.column("c").to_numpy(), kind="stable"))
        within, least = (rows.column(x)[0].as_py() if isinstance(x, str) else x for x in (radius, floor))
        f = np.stack([rows.column(x).to_numpy() for x in FEATURES], axis=1)
        f, n, s = merge_closest(f, *[rows.column(x).to_numpy().astype(float) for x in "ns"], within, least)
        same = rows.select(carried).take(np.zeros(len(f), np.int64))
        return pa.table([*same.columns, np.arange(len(f)), *[np.ascontiguousarray(x) for x in f.T], n, s], [*carried, "c", *FEATURES, "n", "s"])

    kept = ", ".join(f"{c} {clusters.schema[c].dataType.simpleString()}" for c in carried)
    return spread_by(clusters, key).groupBy(key).applyInArrow(run, f"{kept}, c bigint, f0 double, f1 double, f2 double, n double, s double")


def octree_fold(leaves: DataFrame, k: int) -> DataFrame:
    """Finish an octree on fewer than 8k leaves an image: budgeted collapses, then nearest-pair merges in OkLab."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        depth, node = int(pdf["depth"].iloc[0]), pdf["node"].to_numpy(np.int64)
        sums = pdf[["n", "sr", "sg", "sb"]].to_numpy(np.int64)
        for level in range(depth - 1, -1, -1):
            parent = node >> (3 * (depth - level))
            groups, size = np.unique(parent, return_counts=True)
            total = np.array([sums[parent == g, 0].sum() for g in groups])
            for i in np.argsort(total, kind="stable"):
                if 1 < size[i] <= len(node) - k + 1:
                    inside = np.flatnonzero(node >> (3 * (depth - level)) == groups[i])
                    sums[inside[0]] = sums[inside].sum(axis=0)
                    node, sums = np.delete(node, inside[1:]), np.delete(sums, inside[1:], axis=0)
        while len(sums) > k:
            lab = oklab_of(sums[:, 1:] // sums[:, :1])
            d = distances(lab, lab)
            d[np.tril_indices(len(lab))] = np.inf
            i, j = divmod(int(d.argmin()), len(lab))
            sums[i] += sums[j]
            sums = np.delete(sums, j, axis=0)
        out = pd.DataFrame(sums, columns=["n", "sr", "sg", "sb"]).assign(ord=range(len(sums)))
        out["image_id"] = pdf["image_id"].iloc[0]
        return out[["image_id", "ord", "n", "sr", "sg", "sb"]]

    return spread_by(leaves, "image_id").groupBy("image_id").applyInPandas(run, "image_id bigint, ord int, n bigint, sr bigint, sg bigint, sb bigint")


# --- jobs -----------------------------------------------------------------------------------------------------------


def color_points(pixels: DataFrame, space: str, key: str = "image_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """All pixels folded to distinct colours with their number as weight, plus features.

    ``carry`` names further columns that are constant per image.
    """
    folded = pixels.groupBy(key, *carry, *CHANNELS).agg(F.count("*").alias("w"))
    return _featured(folded.withColumn("pos", F.col("r") * 65536 + F.col("g") * 256 + F.col("b")), space)


def _featured(df: DataFrame, space: str) -> DataFrame:
    if space == "lab":
        df, scale, p = kernel.with_lab(df), 1.0, "lab_"
    else:
        df, scale, p = kernel.with_oklab(df), 100.0, "ok_"
    return df.withColumns({f: F.col(p + n) * scale for f, n in zip(FEATURES, "lab")}).drop(*[p + n for n in "lab"])


def _feature_bytes(df: DataFrame, space: str) -> DataFrame:
    f = [F.col(c) for c in FEATURES]
    if space == "lab":
        return kernel.with_lab_bytes(df, *f)
    return kernel.with_oklab_bytes(df, *[c / 100.0 for c in f])


def _cluster_means(points: DataFrame, weight: Column, extra: Column, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Clusters (key, c, f0..f2, n, s): weighted feature means, summed weight, summed extra."""
    means = [(F.sum(F.col(f) * weight) / F.sum(weight)).alias(f) for f in FEATURES]
    return points.groupBy(key, *carry, "c").agg(*means, F.sum(weight).cast("double").alias("n"), F.sum(extra).cast("double").alias("s"))


def kmeans(pixels: DataFrame, k: int = K.PALETTE_SIZE, space: str = "lab", rounds: int = K.LLOYD_ROUNDS) -> DataFrame:
    """k-means per image in Lab or OkLab over all its pixels."""
    points = cluster_points(color_points(pixels, space), k, rounds)
    means = _feature_bytes(_cluster_means(points, F.col("w"), F.lit(0), "image_id"), space)
    share = F.col("n") / F.sum("n").over(Window.partitionBy("image_id"))  # at most k rows
    order = F.row_number().over(Window.partitionBy("image_id").orderBy("c")) - 1
    return means.select("image_id", order.alias("ord"), *CHANNELS, F.col("n").cast("bigint").alias("n"), share.alias("freq"))


def salient_bins(pixels: DataFrame) -> DataFrame:
    """5-bit bins with OkLab features, pixel count and saliency."""
    bins = histogram(pixels, 5)
    s = kernel.hsl_saturation(*[F.col(c) for c in CHANNELS])
    return _featured(bins.withColumn("saliency", kernel.saliency(F.col("n"), s)), "oklab")


def weighted_kmeans(pixels: DataFrame, k: int = K.PALETTE_SIZE, clusters: int | None = None, rounds: int = K.LLOYD_ROUNDS) -> DataFrame:
    """Saliency-weighted over-clustering of bins into ``clusters`` (five per colour), recentred by pixels, merged, ranked by saliency."""
    bins = salient_bins(pixels)
    points = cluster_points(bins.withColumns({"w": F.col("saliency"), "pos": F.col("key")}), _at_least(k, clusters), rounds)
    merged = merge_clusters(_cluster_means(points, F.col("n"), F.col("saliency"), "image_id"), K.WEIGHTED_MERGE_DISTANCE, 1)
    kept = top_k(merged, ["image_id"], [F.col("s").desc(), "c"], k)
    return _palette(_feature_bytes(kept, "oklab"))


def _at_least(k: int, clusters: int | None) -> int:
    clusters = K.CLUSTERS_PER_COLOR * k if clusters is None else clusters
    if clusters < k:
        raise ValueError(f"{clusters} clusters cannot give {k} colours")
    return clusters


def _palette(df: DataFrame, key: str = "image_id", *carry: str) -> DataFrame:
    share = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    return df.select(key, "ord", *CHANNELS, F.col("n").cast("bigint").alias("n"), share.alias("freq"), *carry)


# --- mood presets ----------------------------------------------------------------------------------------------------


def preset_rule(preset: str, **knobs: float) -> dict[str, float]:
    """Bounds and ranking knobs of a preset; explicit non-zero knobs win."""
    name = (preset or "default").strip().lower()
    if name not in K.MOOD_PRESETS:
        raise ValueError(f"unknown preset {preset!r}")
    names = ("min_l", "max_l", "min_c", "max_c", "bias", "exponent", "prefer_l")
    rule = dict(zip(names, K.MOOD_PRESETS[name]))
    return {**rule, **{n: v for n, v in knobs.items() if v}}


def mood_match(rule: dict[str, float]) -> Column:
    """Bounds on OkLCH columns; a zero bound is open."""
    ok = F.lit(True)
    for bound, col, sign in (("min_l", "ok_l", 1), ("max_l", "ok_l", -1), ("min_c", "ok_c", 1), ("max_c", "ok_c", -1)):
        if rule[bound] > 0:
            ok = ok & (F.col(col) >= rule[bound] if sign > 0 else F.col(col) <= rule[bound])
    return ok


def mood_flags(colors: DataFrame, presets: list[str]) -> DataFrame:
    """One boolean per preset, evaluated in the same pass."""
    df = kernel.with_oklch(colors)
    return df.withColumns({f"in_{p}": mood_match(preset_rule(p)) for p in presets}).drop("ok_l", "ok_a", "ok_b", "ok_c", "ok_h")


def mood_filter(pixels: DataFrame, rule: dict[str, float], k: int) -> DataFrame:
    """Pixels that match, or all pixels of an image where fewer than k match.

    Adds ``n_kept`` (pixels kept of the image) and ``fell_back``.
    """
    df = kernel.with_oklch(pixels).withColumn("_in", mood_match(rule)).drop("ok_l", "ok_a", "ok_b", "ok_c", "ok_h")
    df = with_image_totals(df, {"_hits": F.count_if("_in"), "_all": F.count("*")})
    df = df.withColumn("fell_back", F.col("_hits") < k)
    df = df.withColumn("n_kept", F.when(F.col("fell_back"), F.col("_all")).otherwise(F.col("_hits")))
    return df.filter(F.col("_in") | F.col("fell_back")).drop("_in", "_hits", "_all")


def soft(pixels: DataFrame, k: int = K.PALETTE_SIZE, preset: str = "default", count_stop: bool = False,
         merge_distance: float = K.SOFT_MERGE_DISTANCE, clusters: int | None = None, rounds: int = K.LLOYD_ROUNDS, **knobs: float) -> DataFrame:
    """Filter by mood, over-cluster in Lab into ``clusters`` (five per colour), merge similar ones, rank by population and chroma, keep k.

    ``count_stop`` merges down to 1.5 k clusters instead of by distance.
    """
    rule = preset_rule(preset, **knobs)
    facts = ("n_kept", "fell_back")
    points = color_points(mood_filter(pixels, rule, k), "lab", carry=facts)
    points = cluster_points(points, _at_least(k, clusters), rounds)
    means = _feature_bytes(_cluster_means(points, F.col("w"), F.lit(0), "image_id", facts), "lab")
    # clusters continue as 8-bit colours whose population is scaled to all kept pixels
    total = F.sum("n").over(Window.partitionBy("image_id"))  # five rows a colour
    scaled = means.withColumn("n", F.floor(F.col("n") / total * F.col("n_kept") + 0.5).cast("double"))
    clusters = _featured(scaled.drop(*FEATURES), "lab").drop(*CHANNELS, "n_kept")
    radius, floor = (float("inf"), max(int(k * 1.5 + 0.5), 1)) if count_stop else (merge_distance, k)
    merged = kernel.with_oklch(_feature_bytes(merge_clusters(clusters, radius, floor), "lab"))
    weight = F.col("n") * (F.pow("ok_c", kernel.lit(rule["exponent"])) + rule["bias"])
    if rule["prefer_l"]:
        weight = weight * F.greatest(kernel.lit(0), (F.col("ok_l") * 2.0 - 1.0) * rule["prefer_l"] + 1.0)
    ranked = top_k(merged.withColumn("_w", weight), ["image_id"], [F.col("_w").desc(), "c"], k)
    return _palette(ranked, "image_id", "fell_back")


# --- density clusters --------------------------------------------------------------------------------------------------


def dbscan(pixels: DataFrame, k: int = K.PALETTE_SIZE) -> DataFrame:
    """Density clusters of bins ranked by saliency; short palettes are padded with far, salient bins."""
    bins = cut(salient_bins(pixels))
    chosen = top_k(density_clusters(label_density(bins)), ["image_id"], [F.col("s").desc(), "c"], k)
    padded = pad_farthest(bins, chosen, k)
    return _palette(_feature_bytes(padded, "oklab"))


# Bins up to which the neighbours of an image are found in one task.
SMALL_BINS = 1 << 11


def label_density(bins: DataFrame) -> DataFrame:
    """Add ``c``: 0 for noise, else the cluster in order of its first core bin.

    Images of at most ``SMALL_BINS`` bins are labelled one by one where their bins meet, so that no pair of neighbours is
    written; the others go through joins and rounds together.
    """
    number = F.count("*").over(Window.partitionBy("image_id"))  # at most 32,768 bins
    sized = cut(spread_by(bins, "image_id").withColumn("_bins", number))
    small = sized.filter(F.col("_bins") <= SMALL_BINS).drop("_bins")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in small.schema)
    found = spread_by(small, "image_id").groupBy("image_id").applyInArrow(density_labels(K.DENSITY_RADIUS, K.DENSITY_MIN_PIXELS), f"{kinds}, c bigint")
    large = sized.filter(F.col("_bins") > SMALL_BINS).drop("_bins")
    return found if large.isEmpty() else found.unionByName(_label_in_rounds(large))


def _label_in_rounds(bins: DataFrame) -> DataFrame:
    """Labels of images of any number of bins.

    Bins live in a grid of cells one radius wide and meet their neighbours in the 27 cells around by a hash join. Core
    bins pass the smallest key along neighbours, and then along what it leads to, until nothing changes; a border bin
    goes to the earliest cluster that touches it.
    """
    radius, least = K.DENSITY_RADIUS, K.DENSITY_MIN_PIXELS
    points = cut(bins.select("image_id", "key", "n", *FEATURES))
    cells = [F.floor(F.col(f) / radius).cast("int").alias(f"x{i}") for i, f in enumerate(FEATURES)]
    right = points.select("image_id", *cells, F.col("key").alias("j"), F.col("n").alias("w"), *[F.col(f).alias(f"g{i}") for i, f in enumerate(FEATURES)])
    steps = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.lit(z).alias("c")) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    left = points.select("image_id", "key", *FEATURES, *cells, F.explode(steps).alias("at"))
    left = left.withColumns({f"x{i}": F.col(f"x{i}") + F.col(f"at.{c}") for i, c in enumerate("abc")})
    d2 = sum(((F.col(f) - F.col(f"g{i}")) * (F.col(f) - F.col(f"g{i}")) for i, f in enumerate(FEATURES)), F.lit(0.0))
    near = cut(left.join(right, ["image_id", "x0", "x1", "x2"]).filter(d2 <= radius * radius).select("image_id", "key", "j", "w"))
    core = near.groupBy("image_id", "key").agg(F.sum("w").alias("_m")).filter(F.col("_m") >= least).select("image_id", "key")
    to_core = near.select("image_id", "key", "j").join(core.withColumnRenamed("key", "j"), ["image_id", "j"])
    edges = cut(to_core.join(core, ["image_id", "key"]))
    roots = cut(edges.groupBy("image_id", "key").agg(F.min("j").alias("root")))
    while True:
        seen = edges.join(roots.withColumnRenamed("key", "j"), ["image_id", "j"]).groupBy("image_id", "key").agg(F.min("root").alias("low"))
        lead = roots.select("image_id", F.col("key").alias("low"), F.col("root").alias("up"))
        moved = roots.join(seen, ["image_id", "key"]).join(lead, ["image_id", "low"])
        moved = cut(moved.select("image_id", "key", F.col("up").alias("root"), (F.col("up") < F.col("root")).alias("moved")))
        roots = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    touched = to_core.join(roots.withColumnRenamed("key", "j"), ["image_id", "j"]).groupBy("image_id", "key").agg(F.min("root").alias("_root"))
    order = F.dense_rank().over(Window.partitionBy("image_id").orderBy(F.col("_root").asc_nulls_last()))  # at most 32,768 bins
    placed = bins.join(touched, ["image_id", "key"], "left")
    return placed.withColumn("c", F.when(F.col("_root").isNull(), 0).otherwise(order).cast("bigint")).select(*bins.columns, "c")


def density_clusters(labelled: DataFrame) -> DataFrame:
    return _cluster_means(labelled.filter("c > 0"), F.col("n"), F.col("saliency"), "image_id")


def pad_farthest(bins: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """Add, while an image has fewer than k colours, the bin of highest squared distance times saliency: one colour of
    every image a round, the smallest key on ties."""
    spot = F.struct(*FEATURES)
    have = chosen.groupBy("image_id").agg(F.collect_list(spot).alias("centres"))  # at most k
    state = bins.select("image_id").distinct().join(have, "image_id", "left")
    state = cut(state.select("image_id", F.coalesce("centres", F.array().cast("array<struct<f0:double,f1:double,f2:double>>")).alias("centres")))
    out = chosen.select("image_id", "ord", *FEATURES, "n")
    for _ in range(k):
        far = F.when(F.size("centres") == 0, F.lit(1e18)).otherwise(F.array_min(F.transform("centres", _near)))
        seen = bins.join(state.filter(F.size("centres") < k), "image_id")  # at most 32,768 bins an image
        best = seen.groupBy("image_id", "centres").agg(F.max(F.struct((far * F.col("saliency")).alias("score"), (-F.col("key")).alias("key"), *FEATURES, F.col("n").cast("double").alias("n"))).alias("best"))
        best = cut(best.filter("best.score > 0"))
        if best.isEmpty():
            break
        out = out.unionByName(best.select("image_id", F.size("centres").alias("ord"), *[f"best.{c}" for c in (*FEATURES, "n")]))
        state = cut(best.select("image_id", F.concat("centres", F.array(F.struct(*[F.col(f"best.{c}").alias(c) for c in FEATURES]))).alias("centres")))
    return out


# --- whole corpus --------------------------------------------------------------------------------------------------------


def corpus_kmeans(pixels: DataFrame, k: int = K.PALETTE_SIZE, rounds: int = K.LLOYD_ROUNDS, group: str | None = None) -> DataFrame:
    """One k-means palette for everything, or for each value of ``group``, over 5-bit histograms."""
    key = group or "_corpus"
    bins = _featured(histogram(pixels if group else pixels.withColumn(key, F.lit(0)), 5, (key,)), "oklab")
    found = cluster_points(bins.withColumns({"w": F.col("n"), "pos": F.col("key")}), k, rounds, key)
    ranked = top_k(_cluster_means(found, F.col("n"), F.lit(0), key), [key], [F.col("n").desc(), "c"], k)
    palette = _palette(_feature_bytes(ranked, "oklab"), key)
    return palette if group else palette.drop(key)
