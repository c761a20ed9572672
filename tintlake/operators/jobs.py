"""Extraction jobs as a table: image, method, number of colours, preset and knobs are columns.

Jobs with equal parameters are worked out once. The work goes through one plan a method, whatever the number of jobs;
methods whose rounds depend on the number of colours (median cut, Wu, octree, density) take one plan for each number that
occurs, at most ``MAX_PALETTE_SIZE``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import kernel
from ..functions.numeric import FEATURES
from ..runtime import cut, join_color_facts
from . import clusters as cl
from . import extract as ex
from . import pixels as px
from . import quantise as qz

BOUNDS = ("min_l", "max_l", "min_c", "max_c")
KNOBS = (*BOUNDS, "bias", "exponent", "prefer_l")
PARAMETERS = ("method", "k", "preset", *KNOBS, "merge_distance")
_TYPES = {"method": "string", "k": "int", "preset": "string"}


def with_rules(jobs: DataFrame) -> DataFrame:
    """Fill the knobs of rows with a ``preset`` (null: the default) from the table of presets; explicit non-zero knobs
    win. ``known`` is false for a preset that does not exist."""
    presets = jobs.sparkSession.createDataFrame([(p, *map(float, v)) for p, v in K.MOOD_PRESETS.items()], ["_preset", *[f"_{n}" for n in KNOBS]])
    name = F.lower(F.trim(F.coalesce("preset", F.lit(""))))
    met = jobs.withColumn("_preset", F.when(name == "", "default").otherwise(name)).join(F.broadcast(presets), "_preset", "left")  # six rows
    met = met.withColumn("known", F.col(f"_{KNOBS[0]}").isNotNull())
    knobs = {n: F.when(F.coalesce(n, F.lit(0.0)) != 0, F.col(n)).otherwise(F.col(f"_{n}")) for n in KNOBS}
    return met.withColumns(knobs).drop("_preset", *[f"_{n}" for n in KNOBS])


def in_mood() -> Column:
    """Bounds in columns on OkLCH columns; a zero bound is open."""
    tests = [(b, F.col(c) >= F.col(b) if b.startswith("min") else F.col(c) <= F.col(b)) for b, c in zip(BOUNDS, ("ok_l", "ok_l", "ok_c", "ok_c"))]
    return reduce(Column.__and__, [(F.col(b) <= 0) | test for b, test in tests])


def mood_colours(colours: DataFrame, rules: DataFrame) -> DataFrame:
    """Colours (image_id, r, g, b, n) of every job (``unit``, image_id, k, bounds) that match its bounds, or all colours
    where fewer than k pixels match. Adds ``n_kept`` (pixels kept of the job) and ``fell_back``."""
    met = join_color_facts(kernel.with_oklch(colours), rules.select("unit", "image_id", "k", *BOUNDS))
    met = met.withColumn("_in", in_mood()).select("unit", "k", *px.CHANNELS, "n", "_in")
    sums = met.groupBy("unit", "k").agg(F.sum(F.when(F.col("_in"), F.col("n")).otherwise(0)).alias("_hits"), F.sum("n").alias("_all"))
    few = F.col("_hits") < F.col("k")
    sums = sums.select("unit", few.alias("fell_back"), F.when(few, F.col("_all")).otherwise(F.col("_hits")).alias("n_kept"))
    return join_color_facts(met.drop("k"), sums, key="unit").filter(F.col("_in") | F.col("fell_back")).drop("_in")


def _first(df: DataFrame, order: list) -> DataFrame:
    """The first ``k`` rows of a job, k a column."""
    return px.top_k(df, ["unit"], order, K.MAX_PALETTE_SIZE).filter(F.col("ord") < F.col("k"))


def _popularity(pixels: DataFrame, units: DataFrame) -> DataFrame:
    bins = px.top_k(px.histogram(pixels, 5), ["image_id"], [F.col("n").desc(), "key"], K.MAX_PALETTE_SIZE)
    return cl._palette(bins.join(units, "image_id").filter(F.col("ord") < F.col("k")), "unit")


def _kmeans(space: str):
    def run(pixels: DataFrame, units: DataFrame) -> DataFrame:
        points = join_color_facts(cl.color_points(pixels, space), units.select("unit", "image_id", "k")).drop("image_id")
        means = cl._cluster_means(cl.cluster_points(points, "k", key="unit"), F.col("w"), F.lit(0), "unit")
        order = F.row_number().over(Window.partitionBy("unit").orderBy("c")) - 1  # at most k rows
        return cl._palette(cl._feature_bytes(means, space).withColumn("ord", order), "unit")

    return run


def _weighted(pixels: DataFrame, units: DataFrame) -> DataFrame:
    bins = cl.salient_bins(pixels).withColumns({"w": F.col("saliency"), "pos": F.col("key")})
    many = units.select("unit", "image_id", (F.col("k") * K.CLUSTERS_PER_COLOR).alias("_clusters"))
    points = cl.cluster_points(join_color_facts(bins, many).drop("image_id"), "_clusters", key="unit")
    merged = cl.merge_clusters(cl._cluster_means(points, F.col("n"), F.col("saliency"), "unit"), K.WEIGHTED_MERGE_DISTANCE, 1, "unit")
    kept = _first(merged.join(units.select("unit", "k"), "unit"), [F.col("s").desc(), "c"])
    return cl._palette(cl._feature_bytes(kept, "oklab"), "unit")


def _soft(pixels: DataFrame, units: DataFrame) -> DataFrame:
    rules = cut(units)
    kept = cut(mood_colours(px.color_counts(pixels), rules))
    points = kept.withColumns({"w": F.col("n"), "pos": F.col("r") * 65536 + F.col("g") * 256 + F.col("b")}).drop("n", "n_kept", "fell_back")
    many = rules.select("unit", (F.col("k") * K.CLUSTERS_PER_COLOR).alias("_clusters"))
    points = cl.cluster_points(join_color_facts(cl._featured(points, "lab"), many, key="unit"), "_clusters", key="unit")
    means = cl._feature_bytes(cl._cluster_means(points, F.col("w"), F.lit(0), "unit"), "lab")
    facts = kept.groupBy("unit").agg(F.first("n_kept").alias("n_kept"), F.first("fell_back").alias("fell_back"))
    floor = F.when(F.col("method") == "softk", F.greatest(F.floor(F.col("k") * 1.5 + 0.5), F.lit(1))).otherwise(F.col("k")).cast("int")
    radius = F.when(F.col("method") == "softk", float("inf")).otherwise(F.coalesce("merge_distance", F.lit(K.SOFT_MERGE_DISTANCE)))
    facts = facts.join(rules.select("unit", "k", "bias", "exponent", "prefer_l", radius.alias("_radius"), floor.alias("_floor")), "unit")
    total = F.sum("n").over(Window.partitionBy("unit"))  # five rows a colour
    scaled = means.join(facts, "unit").withColumn("n", F.floor(F.col("n") / total * F.col("n_kept") + 0.5).cast("double"))
    few = cl._featured(scaled.drop(*FEATURES), "lab").drop(*px.CHANNELS, "n_kept")
    merged = kernel.with_oklch(cl._feature_bytes(cl.merge_clusters(few, "_radius", "_floor", "unit"), "lab"))
    weight = F.col("n") * (F.pow("ok_c", F.col("exponent")) + F.col("bias"))
    light = F.greatest(kernel.lit(0), (F.col("ok_l") * 2.0 - 1.0) * F.col("prefer_l") + 1.0)
    weight = F.when(F.col("prefer_l") != 0, weight * light).otherwise(weight)
    return cl._palette(_first(merged.withColumn("_w", weight), [F.col("_w").desc(), "c"]), "unit", "fell_back")


def _by_size(method: str):
    def run(pixels: DataFrame, units: DataFrame) -> DataFrame:
        out = []
        for (k,) in sorted(units.select("k").distinct().collect()):  # at most MAX_PALETTE_SIZE
            of = units.filter(F.col("k") == k).select("unit", "image_id")
            palette = ex.METHODS[method](pixels.join(of.select("image_id"), "image_id", "left_semi"), k)
            out.append(palette.join(of, "image_id").select("unit", "ord", *px.CHANNELS, "n", "freq"))
        return reduce(DataFrame.unionByName, out)

    return run


PLANS = {
    ("popularity",): _popularity,
    ("kmeans",): _kmeans("lab"),
    ("okkmeans",): _kmeans("oklab"),
    ("wkmeans",): _weighted,
    ("soft", "softk"): _soft,
    **{(m,): _by_size(m) for m in ("mediancut", "wu", "octree", "dbscan")},
}


def checked(jobs: DataFrame, images: DataFrame) -> DataFrame:
    """Jobs with all parameter columns (null where not given), filled rules, and ``error`` of those that cannot run."""
    given = jobs.withColumns({p: F.lit(None).cast(_TYPES.get(p, "double")) if p not in jobs.columns else F.col(p).cast(_TYPES.get(p, "double")) for p in PARAMETERS})
    given = given.withColumn("k", F.coalesce("k", F.lit(K.PALETTE_SIZE)))
    soft = F.col("method").isin(*ex.PRESET_METHODS)
    blank = {p: F.when(soft, F.col(p)) for p in (*KNOBS, "merge_distance")}
    seen = images.select("image_id", F.lit(True).alias("_seen")).distinct()
    df = with_rules(given).withColumns(blank).join(seen, "image_id", "left")
    error = (
        F.when(~F.coalesce(F.col("method").isin(*ex.METHODS), F.lit(False)), F.concat(F.lit("unknown method "), F.coalesce("method", F.lit("null"))))
        .when(~F.col("k").between(1, K.MAX_PALETTE_SIZE), F.format_string(f"a palette has 1 to {K.MAX_PALETTE_SIZE} colours, not %d", "k"))
        .when(~soft & F.col("preset").isNotNull(), F.concat(F.col("method"), F.lit(" takes no preset")))
        .when(~F.col("known"), F.concat(F.lit("unknown preset "), "preset"))
        .when(F.col("_seen").isNull(), "no pixels")
    )
    return df.withColumn("error", error).select("job", "image_id", *PARAMETERS, "error")


def run_jobs(pixels: DataFrame, jobs: DataFrame, alpha: int = 1) -> tuple[DataFrame, DataFrame]:
    """(palettes, records) of a table of jobs (job, image_id, method, and any of k, preset, knobs, merge_distance).

    Palettes are rows (job, image_id, ord, r, g, b, n, freq, fell_back); a record holds the parameters a job ran with, or
    its error. Job numbers are unique. Pixels below ``alpha`` are left out.
    """
    work = px.opaque(pixels, alpha)
    records = cut(checked(jobs, work))
    # jobs of equal parameters are one unit; null is a value here
    same = ["image_id", *PARAMETERS]
    good = records.filter("error is null").withColumn("preset", F.lit(None).cast("string"))
    units = cut(good.groupBy(*same).agg(F.min("job").alias("unit")))
    asked = {r.method for r in units.select("method").distinct().collect()}  # at most ten
    columns = ["unit", "ord", *px.CHANNELS, "n", "freq", "fell_back"]
    out = None
    for methods, plan in PLANS.items():
        if not asked.intersection(methods):
            continue
        found = plan(work, units.filter(F.col("method").isin(*methods)))
        found = found if "fell_back" in found.columns else found.withColumn("fell_back", F.lit(None).cast("boolean"))
        out = found.select(*columns) if out is None else out.unionByName(found.select(*columns))
    if out is None:
        empty = "job bigint, image_id bigint, ord int, r int, g int, b int, n bigint, freq double, fell_back boolean"
        return pixels.sparkSession.createDataFrame([], empty), records
    return _members(good, units, same).join(out, "unit").drop("unit"), records


def _members(good: DataFrame, units: DataFrame, same: list[str]) -> DataFrame:
    """Jobs with their unit: (job, image_id, unit)."""
    a, b = good.alias("a"), units.alias("b")
    met = a.join(b, reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same]))
    return met.select("a.job", "a.image_id", "b.unit")
