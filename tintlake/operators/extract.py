"""One extraction job: mask, optional resize, a method, optional source positions and slot order, and what was done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from . import clusters as cl
from . import pixels as px
from . import quantise as qz
from . import strips as st

METHODS: dict[str, Callable[..., DataFrame]] = {
    "popularity": qz.popularity,
    "mediancut": qz.median_cut,
    "wu": qz.wu,
    "octree": qz.octree,
    "kmeans": cl.kmeans,
    "okkmeans": lambda p, k, **o: cl.kmeans(p, k, space="oklab", **o),
    "wkmeans": cl.weighted_kmeans,
    "soft": cl.soft,
    "softk": lambda p, k, **o: cl.soft(p, k, count_stop=True, **o),
    "dbscan": cl.dbscan,
}
PRESET_METHODS = ("soft", "softk")


def extract(pixels: DataFrame, images: DataFrame, method: str, k: int = K.PALETTE_SIZE, preset: str | None = None, resize: int | None = None,
            sort_by: str | None = None, reverse: bool = False, alpha: int = 1, located: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """(palette, record) of all images.

    Pixels below ``alpha`` are left out; images are reduced only if ``resize`` names a side; a preset belongs to the soft
    methods and is refused elsewhere. ``sort_by`` renumbers the slots, ``located`` adds the nearest source pixel. The
    record holds the parameters that took effect, and no others.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    if preset is not None and method not in PRESET_METHODS:
        raise ValueError(f"{method} takes no preset")
    if not 1 <= k <= K.MAX_PALETTE_SIZE:
        raise ValueError(f"a palette has 1 to {K.MAX_PALETTE_SIZE} colours, not {k}")
    work = px.opaque(pixels, alpha)
    if resize is not None:
        sized = px.pixel_stats(pixels, alpha).select("image_id", "n_total")
        work = px.downsample(work, images.drop("n_total").join(sized, "image_id"), resize)
    params = {"palette_size": k, "resize": resize, "preset": preset, "sort_by": sort_by, "reverse": True if sort_by and reverse else None}
    palette = METHODS[method](work, k, **({"preset": preset} if preset else {}), **options)
    if located:
        palette = qz.annotate(palette, pixels, images)
    if sort_by:
        renumbered = st.order_palettes(palette.withColumnRenamed("image_id", "palette_id"), sort_by, reverse)
        palette = renumbered.drop("ord").withColumnsRenamed({"palette_id": "image_id", "new_ord": "ord"})
    used = {name: str(value) for name, value in {**params, **options}.items() if value is not None}
    return palette, qz.provenance(px.pixel_stats(pixels, alpha), images, method, used)


def extract_jobs(pixels: DataFrame, images: DataFrame, jobs: list[dict]) -> tuple[DataFrame, DataFrame]:
    """A small list of jobs (keyword arguments of ``extract``) over the same images, told apart by ``job``."""
    palettes, records = None, None
    for number, job in enumerate(jobs):
        palette, record = (df.withColumn("job", F.lit(number)) for df in extract(pixels, images, **job))
        palettes = palette if palettes is None else palettes.unionByName(palette, allowMissingColumns=True)
        records = record if records is None else records.unionByName(record)
    return palettes, records
