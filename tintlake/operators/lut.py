"""Colour-grading lattices: tables of size^3 nodes per palette (red fastest), and their use on pixels."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernel
from ..functions.numeric import merged_hues
from ..runtime import join_image_facts, salted_join, spread_by
from .gradient import _mix_hue

DEFAULT_SIZE, MAX_SIZE = 33, 256
NEUTRAL_CHROMA = 0.02
MERGE_DEGREES = 2.0
MAX_GAIN = 6.0
MUTE_REACH = 90.0
METHODS = ["knn", "rbf", "grade"]


def checked_size(size: int) -> int:
    if size > MAX_SIZE:
        raise ValueError(f"size above {MAX_SIZE}")
    return DEFAULT_SIZE if size < 2 else size


def _knob(value: Column | float) -> Column:
    """A number for all palettes, or a column with one for each."""
    return value if isinstance(value, Column) else kernel.lit(value)


def _size(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(checked_size(value))


def _is(value: Column | float, number: float) -> bool:
    return not isinstance(value, Column) and value == number


def _nodes(df: DataFrame, size: Column) -> DataFrame:
    """Each row once per lattice node, with the node's own colour c_r, c_g, c_b."""
    df = df.withColumn("size", size).withColumn("node", F.explode(F.sequence(F.lit(0), F.expr("cast(size * size * size - 1 as int)"))))
    axes = {"c_r": F.expr("node % size"), "c_g": F.expr("(node div size) % size"), "c_b": F.expr("node div (size * size)")}
    return df.withColumns({n: kernel.byte(v / (F.col("size") - 1.0)) for n, v in axes.items()})


def identity_lattice(palettes: DataFrame, size: Column | int) -> DataFrame:
    """Unchanged lattice for every palette id; sizes below 2 mean the default."""
    size = F.lit(size) if isinstance(size, int) else size
    size = F.when(size < 2, DEFAULT_SIZE).otherwise(size).cast("int")
    out = _nodes(palettes, size)
    return out.select("palette_id", "size", "node", F.col("c_r").alias("r"), F.col("c_g").alias("g"), F.col("c_b").alias("b"))


def _oklch_of(palettes: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    same = ("palette_id", "ord", *carry)
    return kernel.with_oklch(palettes.select(*same, "r", "g", "b"), p="p_").select(*same, "p_l", "p_a", "p_b", "p_c", "p_h")


def _with_distance(df: DataFrame) -> DataFrame:
    gaps = [F.col(f"n_{c}") - F.col(f"p_{c}") for c in "lab"]
    return df.withColumn("d", F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]))


def _colours_at_nodes(palettes: DataFrame, size: Column | int, carry: tuple[str, ...]) -> DataFrame:
    """Palette colours x lattice nodes with OkLab of both and their distance.

    The lattice is generated inside each colour's row, so this is a narrow step; the aggregation that follows
    is keyed by (palette_id, node) and combines map-side.
    """
    return _with_distance(kernel.with_oklch(_nodes(_oklch_of(palettes, carry), _size(size)), "c_r", "c_g", "c_b", "n_"))


# Most cells an axis of a palette's grid, and blocks an axis of a lattice.
GRID_CELLS, GRID_BLOCKS = 32, 9
# Colours up to which a palette stays in one task with all its nodes.
SMALL_PALETTE = 64
_BOX = [f"{end}_{c}" for end in ("lo", "hi") for c in "lab"]


def _boxes(p: str) -> list[Column]:
    return [end(f"{p}_{c}").alias(f"{name}_{c}") for name, end in (("lo", F.min), ("hi", F.max)) for c in "lab"]


def _by_size(colours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Colours of palettes of at most ``SMALL_PALETTE`` colours, those of a palette in one task, and all others.

    Nodes are made behind an explicit shuffle of the few colours: a shuffle that Spark merges by its size would put most
    nodes into one task. Windows and sums by (palette, node) need no further shuffle where a palette is in one task.
    """
    counts = colours.groupBy("palette_id").agg(F.count("*").alias("_colours"))
    sized = salted_join(colours, counts, ["palette_id"], F.xxhash64("r", "g", "b"), many_facts=True)
    small = F.col("_colours") <= SMALL_PALETTE
    return spread_by(sized.filter(small).drop("_colours"), "palette_id"), sized.filter(~small).drop("_colours")


def _near_colours_at_nodes(palettes: DataFrame, size: Column | int, carry: tuple[str, ...], k: int) -> DataFrame:
    """As ``_colours_at_nodes``, of each node only the colours that can be among its ``k`` nearest.

    Colours lie in the cells of an OkLab grid that is as fine as the palette is large, nodes in blocks of neighbours (at
    most 9^3 a lattice). Of the boxes around a cell's colours and a block's nodes, the least and the greatest distance
    are known: a block needs no cell that begins farther away than ``k`` colours of other cells end. The nodes of a block
    sift its cells once more, each by its own distances, and only then meet the colours. Of equal colours
    of a palette only the first ``k`` slots can matter.
    """
    first = F.row_number().over(Window.partitionBy("palette_id", "r", "g", "b").orderBy("ord"))
    distinct = palettes.withColumn("_copy", first).filter(F.col("_copy") <= k)
    colours = _oklch_of(distinct, carry).withColumn("size", _size(size))
    counts = colours.groupBy("palette_id").agg(F.ceil(F.cbrt(2 * F.count("*"))).alias("_grid"))
    colours = salted_join(colours, counts, ["palette_id"], F.xxhash64("ord"), many_facts=True)
    cells = F.least(F.col("_grid"), F.lit(GRID_CELLS))
    at = [F.floor((F.col(f"p_{c}") + low) * cells).cast("int").alias(f"x_{c}") for c, low in (("l", 0.0), ("a", 0.5), ("b", 0.5))]
    colours = colours.withColumn("cell", F.struct(*at)).drop("_grid")
    full = colours.groupBy("palette_id", "size", "cell").agg(*_boxes("p"), F.count("*").alias("n"))
    lattice = kernel.with_oklch(_nodes(colours.select("size").distinct(), F.col("size")), "c_r", "c_g", "c_b", "n_")
    edge = F.expr(f"(size + {GRID_BLOCKS - 1}) div {GRID_BLOCKS}")
    across = F.expr(f"(size + (size + {GRID_BLOCKS - 1}) div {GRID_BLOCKS} - 1) div ((size + {GRID_BLOCKS - 1}) div {GRID_BLOCKS})")
    axis = lambda v: F.floor(v / edge).cast("int")
    block = axis(F.expr("node % size")) + axis(F.expr("(node div size) % size")) * across + axis(F.expr("node div (size * size)")) * across * across
    blocks = lattice.groupBy("size", block.alias("block")).agg(*[c.alias(f"b_{n}") for c, n in zip(_boxes("n"), _BOX)])
    bound = lambda lo, hi: ([F.greatest(F.col(f"lo_{c}") - F.col(f"{hi}_{c}"), F.col(f"{lo}_{c}") - F.col(f"hi_{c}"), kernel.lit(0)) for c in "lab"], [F.greatest(F.col(f"hi_{c}") - F.col(f"{lo}_{c}"), F.col(f"{hi}_{c}") - F.col(f"lo_{c}")) for c in "lab"])
    squared = lambda v: v[0] * v[0] + v[1] * v[1] + v[2] * v[2]

    def within_reach(pairs: DataFrame, of: str, lo: str, hi: str) -> DataFrame:
        """Cells that can hold one of the ``k`` nearest of each block or node ``of``; a palette has its grid's cells at most."""
        near, far = bound(lo, hi)
        some = Window.partitionBy("palette_id", "size", of)
        pairs = pairs.withColumns({"near": squared(near), "far": squared(far)}).withColumn("_reached", F.sum("n").over(some.orderBy("far", "cell")))
        pairs = pairs.withColumn("_enough", F.min(F.when(F.col("_reached") >= k, F.col("far"))).over(some))
        return pairs.filter(F.col("_enough").isNull() | (F.col("near") <= F.col("_enough") * (1 + 1e-9) + 1e-12))

    pairs = full.join(F.broadcast(blocks), "size")  # at most 9^3 blocks a size, 255 sizes
    met = within_reach(pairs, "block", "b_lo", "b_hi").select("palette_id", "size", "cell", "block", "n", *_BOX)
    steps = [F.expr(f"sequence(({v}) * e, least(({v}) * e + e, size) - 1)") for v in ("block % w", "(block div w) % w", "block div (w * w)")]
    met = met.withColumns({"e": edge, "w": across}).withColumn("_r", F.explode(steps[0])).withColumn("_g", F.explode(steps[1])).withColumn("_b", F.explode(steps[2]))
    met = met.withColumn("node", F.expr("cast(_r + _g * size + _b * size * size as int)")).drop("e", "w", "block")
    met = met.withColumns({f"c_{c}": kernel.byte(F.col(f"_{c}") / (F.col("size") - 1.0)) for c in "rgb"}).drop("_r", "_g", "_b")
    met = within_reach(kernel.with_oklch(met, "c_r", "c_g", "c_b", "n_"), "node", "n", "n")
    seen = met.select("palette_id", "size", "cell", "node", "c_r", "c_g", "c_b", *[f"n_{c}" for c in "labch"])
    return _with_distance(colours.join(seen, ["palette_id", "size", "cell"]).drop("cell"))


KEYS = ["palette_id", "size", "node", "n_l", "n_a", "n_b", "n_c", "n_h"]


def knn_lattice(palettes: DataFrame, size: int = DEFAULT_SIZE, radius: float = 0.40, distribution: float = 0.15,
                intensity: float = 0.90, neighbours: int = 2, saturation: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pull each node's hue (and chroma, if asked) towards its nearest palette colours.

    Size and knobs are numbers, or columns of ``palettes`` that are constant per palette and named in ``carry``."""
    if _is(intensity, 0):
        return identity_lattice(palettes.select("palette_id").distinct(), checked_size(size))
    few, many = _by_size(palettes)
    rank = F.row_number().over(Window.partitionBy("palette_id", "node").orderBy("d", "ord"))
    sums = None
    for near in (_colours_at_nodes(few, size, carry), _near_colours_at_nodes(many, size, carry, max(neighbours, 1))):
        part = _nearest_sums(near.withColumn("rank", rank).filter(F.col("rank") <= max(neighbours, 1)), carry)
        sums = part if sums is None else sums.unionByName(part)
    reach = _knob(radius)
    far = F.when(reach > 0, F.least(F.col("d0") / reach, kernel.lit(1))).otherwise(kernel.lit(1))
    sums = kernel.staged(
        sums,
        {"pull": F.pow(kernel.lit(1) - far, _knob(distribution) * 2.0) * _knob(intensity), "th": kernel.hue_of(F.col("wx"), F.col("wy"))},
        {"nc": F.col("n_c") + (F.col("wc") / F.col("w") - F.col("n_c")) * F.col("pull") if saturation else F.col("n_c")},
        {"nh": _mix_hue(F.col("n_h"), F.col("th"), F.col("pull"))},
    )
    return _lattice(kernel.with_oklch_bytes(sums, F.col("n_l"), F.col("nc"), F.col("nh")))


def _nearest_sums(near: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    w = kernel.lit(1) / (F.col("d") + 1e-6)
    rad = F.radians("p_h")
    return near.groupBy(*KEYS, *carry).agg(
        F.min("d").alias("d0"), F.sum(w).alias("w"), F.sum(w * F.col("p_c")).alias("wc"),
        F.sum(w * F.cos(rad)).alias("wx"), F.sum(w * F.sin(rad)).alias("wy"),
    )


def rbf_lattice(palettes: DataFrame, size: int = DEFAULT_SIZE, reach: float = 0.20, sharpness: float = 2.0,
                strength: float = 0.90, saturation: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Blend each node towards all palette colours with weights exp(-(d / reach)^sharpness); knobs as in ``knn_lattice``."""
    if _is(strength, 0):
        return identity_lattice(palettes.select("palette_id").distinct(), checked_size(size))
    w = F.exp(-F.pow(F.col("d") / _knob(reach), _knob(sharpness))) * F.col("_n")
    # equal colours of a palette weigh once for all
    folded = palettes.groupBy("palette_id", *carry, "r", "g", "b").agg(F.min("ord").alias("ord"), F.count("*").alias("_n"))
    few, many = _by_size(folded)
    sums = None
    for colours in (few, spread_by(many, "palette_id", "r", "g", "b")):
        met = _colours_at_nodes(colours, size, (*carry, "_n")).withColumn("w", w).groupBy(*KEYS, *carry)
        met = met.agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("p_a")).alias("wa"), F.sum(F.col("w") * F.col("p_b")).alias("wb"))
        sums = met if sums is None else sums.unionByName(met)
    heavy = F.col("sw") > 1e-12

    def blended(n: str, s: str) -> Column:
        target = F.when(heavy, F.col(s) / F.col("sw")).otherwise(F.col(n))
        return F.col(n) + (target - F.col(n)) * _knob(strength)

    sums = kernel.staged(sums, {"na": blended("n_a", "wa"), "nb": blended("n_b", "wb")})
    if not saturation:
        sums = sums.withColumn("mag", F.sqrt(F.col("na") * F.col("na") + F.col("nb") * F.col("nb")))
        keep = F.when(F.col("mag") > 1e-12, F.col("n_c") / F.col("mag")).otherwise(1.0)
        sums = kernel.staged(sums, {"keep": keep}, {"na": F.col("na") * F.col("keep"), "nb": F.col("nb") * F.col("keep")})
    return _lattice(kernel.with_oklab_bytes(sums, F.col("n_l"), F.col("na"), F.col("nb")))


def _lattice(df: DataFrame) -> DataFrame:
    return df.select("palette_id", "size", "node", "r", "g", "b")


# --- hue-wheel compression ------------------------------------------------------------------------------------


def hue_anchors(palettes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Hue anchors of each palette (palette_id, *carry, h, c), after merging anchors closer than 2 degrees.

    Merging keeps a running mean in hue order. It never reaches across a gap of 2 degrees, so each run of hues between
    such gaps is merged by itself: runs are found from the least and greatest hue of every degree, and a run's colours
    pass through one task in order, of which it keeps the last anchor only.
    """
    lch = kernel.with_oklch(palettes).filter(F.col("ok_c") >= NEUTRAL_CHROMA)
    spokes = lch.select("palette_id", *carry, "ord", F.col("ok_h").alias("h"), F.col("ok_c").alias("c")).withColumn("degree", F.floor("h").cast("int"))
    order = Window.partitionBy("palette_id").orderBy("degree")  # at most 360 rows
    degrees = spokes.groupBy("palette_id", "degree").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    degrees = degrees.withColumn("fresh", (F.col("lo") - F.lag("hi").over(order) >= MERGE_DEGREES).cast("int"))
    runs = degrees.select("palette_id", "degree", F.sum(F.coalesce("fresh", F.lit(1))).over(order).alias("run"))
    # a degree goes to one task with its run anyway; the planner takes these rows for few and would broadcast them
    placed = spokes.join(runs.hint("merge"), ["palette_id", "degree"]).drop("degree")
    ordered = spread_by(placed, "palette_id", "run").sortWithinPartitions("palette_id", "run", "h", "ord")
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    names = ["palette_id", *carry, "run", "h", "c"]
    return ordered.select(*names).mapInArrow(merged_hues(MERGE_DEGREES), ", ".join(f"{n} {kinds[n]}" for n in names)).drop("run")


def hue_wheels(palettes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a palette (palette_id, *carry, m, an, below): its number of anchors, the anchors in hue order (at least 2
    degrees apart, so 180 at most) and, for each degree, how many anchors lie below it."""
    none = palettes.select("palette_id", *carry).distinct().withColumn("at", F.lit(None).cast("struct<h:double,c:double>"))
    anchors = hue_anchors(palettes, carry).select("palette_id", *carry, F.struct("h", "c").alias("at"))
    wheels = none.unionByName(anchors).groupBy("palette_id", *carry).agg(F.array_sort(F.collect_list("at")).alias("an"))
    wheels = spread_by(wheels, "palette_id").withColumn("m", F.size("an"))
    below = F.transform(F.sequence(F.lit(0), F.lit(360)), lambda d: F.size(F.filter("an", lambda x: x["h"] < d)))
    return wheels.withColumn("below", below)


def grade_lattice(palettes: DataFrame, size: int = DEFAULT_SIZE, compression: float = 0.70, mute: float = 0.30,
                  saturation: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Squeeze hues onto the palette's spokes; lightness stays, chroma is muted between spokes and kept in gamut. Knobs as
    in ``knn_lattice``.

    A palette's wheel is one bounded row. The lattice is generated from it, and a node finds the gap between two anchors
    that holds its hue by its degree: a degree holds one anchor at most.
    """
    df = kernel.with_oklch(_nodes(hue_wheels(palettes, carry), _size(size)), "c_r", "c_g", "c_b", "n_")
    h, m = F.col("n_h"), F.col("m")
    start = F.get("below", F.floor(h).cast("int"))
    df = df.withColumn("_start", start)
    passed = F.col("_start") + F.when(F.get("an", F.col("_start"))["h"] <= h, 1).otherwise(0)
    df = df.withColumn("_i", F.when(m > 0, F.pmod(passed - 1 + m, F.greatest(m, F.lit(1)))))
    ends = {"lo": F.get("an", F.col("_i")), "hi": F.get("an", F.pmod(F.col("_i") + 1, F.greatest(m, F.lit(1))))}
    df = df.withColumns({f"{e}_{x}": v[x] for e, v in ends.items() for x in "hc"}).drop("an", "below", "_start", "_i")
    width = F.col("hi_h") - F.col("lo_h")
    df = df.withColumn("width", F.when(width <= 0, width + 360.0).otherwise(width))
    df = kernel.fence(df, {n: F.col(n) for n in ("n_l", "n_c", "n_h", "lo_h", "lo_c", "hi_c", "width")}).drop("n_a", "n_b", "hi_h")
    lo = F.col("lo_h")
    t = F.least(kernel.wrap(h - lo) / F.col("width"), kernel.lit(1))
    compression, mute = _knob(compression), _knob(mute)
    power = F.pow(kernel.lit(MAX_GAIN), compression)
    df = kernel.staged(df, {"t": t}, {"up": F.pow("t", power), "down": F.pow(kernel.lit(1) - F.col("t"), power)})
    bent = F.when(F.col("t") <= 0, 0.0).when(F.col("t") >= 1, 1.0).otherwise(F.col("up") / (F.col("up") + F.col("down")))
    df = df.withColumn("bent", bent)
    edge = F.least(F.col("t"), kernel.lit(1) - F.col("t")) * F.col("width") / MUTE_REACH
    df = df.withColumns({
        "wh": F.coalesce(F.pmod(lo + F.col("bent") * F.col("width"), kernel.lit(360)), h),
        "wc": F.coalesce(F.col("lo_c") + (F.col("hi_c") - F.col("lo_c")) * F.col("bent"), kernel.lit(0)),
        "edge": kernel.clamp(F.coalesce(edge, kernel.lit(0))),
    })
    chroma = F.col("n_c")
    pulls = F.lit(saturation) & (compression > 0)
    chroma = F.when(pulls, chroma + (F.col("wc") - chroma) * compression).otherwise(chroma)
    smooth = F.col("edge") * F.col("edge") * (kernel.lit(3) - F.col("edge") * 2.0)
    chroma = F.when((F.col("m") > 0) & (mute > 0), chroma * (kernel.lit(1) - smooth * mute)).otherwise(chroma)
    df = kernel.with_clipped_chroma(df.withColumn("nc", chroma), "n_l", "nc", "wh", "nc")
    df = kernel.with_oklch_bytes(df, F.col("n_l"), F.col("nc"), F.col("wh"))
    idle = ~pulls & ((F.col("m") == 0) | ((compression <= 0) & (mute <= 0)))
    same = [F.when(idle, F.col(f"c_{c}")).otherwise(F.col(c)).alias(c) for c in "rgb"]
    return df.select("palette_id", "size", "node", *same)


def make_lattice(palettes: DataFrame, method: str = "", **knobs) -> DataFrame:
    """Lattices by method; the empty method means k-NN."""
    makers = {"": knn_lattice, "knn": knn_lattice, "rbf": rbf_lattice, "grade": grade_lattice}
    if method not in makers:
        raise ValueError(f"unknown method {method!r}")
    return makers[method](palettes, **knobs)


def check_jobs(jobs: DataFrame) -> DataFrame:
    """Lattice requests with resolved method and size, or the reason each cannot run."""
    c = F.col
    method = F.when(c("method") == "", "knn").otherwise(c("method"))
    unit = lambda n: (c(n) < 0) | (c(n) > 1)
    error = (
        F.when(c("size") > MAX_SIZE, "size above 256")
        .when(~method.isin(*METHODS), "unknown method")
        .when((method == "knn") & (c("radius") < 0), "radius below 0")
        .when((method == "knn") & unit("distribution"), "distribution outside 0..1")
        .when((method == "knn") & unit("intensity"), "intensity outside 0..1")
        .when((method == "rbf") & (c("reach") <= 0), "reach not above 0")
        .when((method == "rbf") & (c("sharpness") <= 0), "sharpness not above 0")
        .when((method == "rbf") & unit("strength"), "strength outside 0..1")
        .when((method == "grade") & unit("compression"), "compression outside 0..1")
        .when((method == "grade") & unit("mute"), "mute outside 0..1")
    )
    size = F.when(c("size") < 2, DEFAULT_SIZE).otherwise(c("size"))
    return jobs.withColumns({"error": error, "method": method, "size": size})


KNOBS = {
    "knn": ("radius", "distribution", "intensity"),
    "rbf": ("reach", "sharpness", "strength"),
    "grade": ("compression", "mute"),
}


def run_jobs(palettes: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lattices, refused): lattices (job_id, size, node, r, g, b) of all requests (job_id, palette_id, method, size,
    knobs), each with its own size and knobs, in one plan a method however many jobs there are; refused jobs with error."""
    checked = check_jobs(jobs)
    good, out = checked.filter(F.col("error").isNull()), None
    for method, make in (("knn", knn_lattice), ("rbf", rbf_lattice), ("grade", grade_lattice)):
        carry = tuple(f"_{k}" for k in (*KNOBS[method], "size"))
        mine = good.filter(F.col("method") == method).select("job_id", "palette_id", *[F.col(c[1:]).cast("int" if c == "_size" else "double").alias(c) for c in carry])
        keyed = palettes.select("palette_id", "ord", "r", "g", "b").join(mine, "palette_id").drop("palette_id").withColumnRenamed("job_id", "palette_id")
        made = make(keyed, size=F.col("_size"), **{k: F.col(f"_{k}") for k in KNOBS[method]}, carry=carry)
        made = made.select(F.col("palette_id").alias("job_id"), "size", "node", "r", "g", "b")
        out = made if out is None else out.unionByName(made)
    return out, checked.filter(F.col("error").isNotNull()).select("job_id", "method", "error")


# --- application ---------------------------------------------------------------------------------------------------


def apply_lattice(pixels: DataFrame, assigned: DataFrame, lattice: DataFrame, pixel_count: str = "n_total") -> DataFrame:
    """Grade every pixel by trilinear interpolation in the lattice assigned to its image.

    ``assigned`` holds (image_id, palette_id, pixel count). Each distinct (palette, colour) is graded once: its eight
    corners meet the lattice by a hash join on (palette, node), and the result goes back to the pixels by a salted join,
    so neither a widely used palette nor a background colour is a hot key, and no lattice is gathered.
    """
    sizes = lattice.filter("node = 0").select("palette_id", "size")
    facts = assigned.join(sizes, "palette_id").select("image_id", "palette_id", pixel_count, "size")
    placed = join_image_facts(pixels, facts, pixel_count).select("image_id", "idx", "palette_id", "size", "r", "g", "b")
    colors = placed.select("palette_id", "size", "r", "g", "b").distinct()
    top = F.col("size") - 1
    at = {f"_{c}": F.col(c) / 255.0 * top for c in "rgb"}
    base = {f"_i{c}": F.least(F.floor(F.col(f"_{c}")).cast("int"), F.col("size") - 2) for c in "rgb"}
    part = {f"_f{c}": F.col(f"_{c}") - F.col(f"_i{c}") for c in "rgb"}
    df = kernel.staged(colors, at, base, part)
    corners = [(x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1)]

    def node(x: int, y: int, z: int) -> Column:
        return (F.col("_ir") + x) + (F.col("_ig") + y) * F.col("size") + (F.col("_ib") + z) * F.col("size") * F.col("size")

    def weight(x: int, y: int, z: int) -> Column:
        w = None
        for c, bit in zip("rgb", (x, y, z)):
            f = F.col(f"_f{c}") if bit else kernel.lit(1) - F.col(f"_f{c}")
            w = f if w is None else w * f
        return w

    spots = [F.struct(F.lit(i).alias("corner"), node(*c).cast("bigint").alias("node"), weight(*c).alias("w")) for i, c in enumerate(corners)]
    spread = df.select("palette_id", "r", "g", "b", F.inline(F.array(*spots)))
    nodes = lattice.select("palette_id", F.col("node").cast("bigint").alias("node"), *[F.col(c).alias(f"n{c}") for c in "rgb"])
    # the planner's estimate ignores that a palette's row became size^3 nodes, and would broadcast them
    met = spread.join(nodes.hint("merge"), ["palette_id", "node"])
    # A column for each corner keeps the order of the sum, whatever the order of arrival.
    terms = [F.max(F.when(F.col("corner") == i, F.col(f"n{c}") * F.col("w"))).alias(f"{c}{i}") for c in "rgb" for i in range(8)]
    summed = met.groupBy("palette_id", "r", "g", "b").agg(*terms)
    out = []
    for c in "rgb":
        v = kernel.lit(0)
        for i in range(8):
            v = v + F.col(f"{c}{i}")
        out.append(F.floor(v + 0.5).cast("int").alias(f"out_{c}"))
    graded = summed.select("palette_id", "r", "g", "b", *out)
    return salted_join(placed, graded, ["palette_id", "r", "g", "b"], F.col("idx"), many_facts=True).select("image_id", "idx", "palette_id", "out_r", "out_g", "out_b")
