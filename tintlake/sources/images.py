"""Image sources: files, inline data URIs, and pre-decoded pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread_by

# Pixels of one band of an image.
BAND_PIXELS = 1 << 16
# Pixels that are cut out of a band together: a pixel's row carries the bytes of these only, not of its band.
CUT_PIXELS = 64
PIXEL_COLUMNS = ["image_id", "idx", "x", "y", "r", "g", "b", "a"]


def _path(c: str) -> Column:
    """Spark writes local paths as file:/ or file:///; use one form."""
    return F.regexp_replace(F.col(c), "^file:/+", "file:/")


def _sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(_path("path").alias("image_id"), F.col("length").alias("bytes"))


def read_images(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Decoded images (image_id = file path, w, h, channels, data) by Spark's own image source.

    Files it cannot decode, and files above ``max_bytes`` if given, stay as rows with null size and data.
    """
    if max_bytes is not None:
        fits = _sizes(spark, path).filter(F.col("bytes") <= max_bytes).select("image_id", F.lit(True).alias("_fits"))
        images = read_images(spark, path).join(fits, "image_id", "left")
        return images.select("image_id", *[F.when(F.col("_fits"), F.col(c)).alias(c) for c in ("w", "h")], "channels", F.when(F.col("_fits"), F.col("data")).alias("data"))
    images = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    bad = F.col("width") < 1
    return images.select(
        _path("origin").alias("image_id"),
        F.when(~bad, F.col("width")).alias("w"),
        F.when(~bad, F.col("height")).alias("h"),
        F.col("nChannels").alias("channels"),
        F.when(~bad, F.col("data")).alias("data"),
    )


def image_pixels(images: DataFrame) -> DataFrame:
    """Every pixel in raster order; stored channel order is B, G, R[, A], one channel is grey.

    Images are cut into bands of rows that are dealt out before bytes are read, so a large image is many tasks. Fully transparent pixels become transparent black.
    """
    high = F.greatest(F.floor(F.lit(BAND_PIXELS) / F.col("w")), F.lit(1)).cast("int")
    bands = images.filter(F.col("data").isNotNull()).withColumn("_high", high)
    bands = bands.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("h") - 1, F.col("_high"))))
    rows = F.least(F.col("_high"), F.col("h") - F.col("_y"))
    start = (F.col("_y") * F.col("w") * F.col("channels") + 1).cast("int")
    part = F.substring("data", start, (rows * F.col("w") * F.col("channels")).cast("int"))
    return band_pixels(bands.select("image_id", "w", "channels", F.col("_y").alias("y"), (rows * F.col("w")).alias("n"), part.alias("data")))


def band_pixels(bands: DataFrame) -> DataFrame:
    """Every pixel of bands (image_id, w, channels, y of the first row, n pixels, data); bands without data give none."""
    bands = bands.filter(F.col("data").isNotNull() & (F.col("n") > 0)).select("image_id", "w", "channels", F.col("y").alias("_y"), F.col("n").cast("int").alias("_n"), "data")
    df = spread_by(bands, "image_id", "_y").withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(CUT_PIXELS))))
    part = F.substring("data", F.col("_from") * F.col("channels") + 1, F.col("channels") * CUT_PIXELS)
    df = df.select("image_id", "w", "channels", "_y", "_from", F.least(F.lit(CUT_PIXELS), F.col("_n") - F.col("_from")).alias("_n"), part.alias("data"))
    df = df.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    df = df.withColumn("idx", F.col("_y").cast("bigint") * F.col("w") + F.col("_from") + F.col("_at"))

    def channel(n: int) -> Column:
        at = (F.col("_at") * F.col("channels") + n + 1).cast("int")
        return F.ascii(F.decode(F.substring("data", at, 1), "ISO-8859-1"))

    grey = F.col("channels") == 1
    alpha = F.when(F.col("channels") == 4, channel(3)).otherwise(255)
    rgb = {c: F.when(grey, channel(0)).otherwise(channel(n)) for c, n in (("r", 2), ("g", 1), ("b", 0))}
    df = df.withColumns({"a": alpha, **rgb})
    shown = [F.when(F.col("a") == 0, 0).otherwise(F.col(c)).alias(c) for c in "rgb"]
    x = (F.col("idx") % F.col("w")).cast("int").alias("x")
    y = F.floor(F.col("idx") / F.col("w")).cast("int").alias("y")
    return df.select("image_id", "idx", x, y, *shown, "a")


def scan_report(spark: SparkSession, path: str, images: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """One row per file under ``path``: size in bytes and why ``read_images`` with the same limit left it out, if so."""
    files = _sizes(spark, path)
    seen = images.select("image_id", F.col("data").isNotNull().alias("_ok"))
    error = F.when(F.col("bytes") > F.lit(max_bytes), f"payload above {max_bytes} bytes").when(~F.coalesce("_ok", F.lit(False)), "cannot decode")
    return files.join(seen, "image_id", "left").withColumn("error", error).drop("_ok")


def inline_images(rows: DataFrame, uri: str = "uri", max_bytes: int | None = None) -> DataFrame:
    """Payload of ``data:...;base64,`` URIs as ``content``; anything else keeps its row with ``error``."""
    body = F.regexp_replace(F.col(uri), "^data:", "")
    comma = F.instr(body, ",")
    df = rows.withColumns({"_meta": F.expr("''"), "_body": body, "_comma": comma})
    df = df.withColumns(
        {
            "_meta": F.when(F.col("_comma") > 0, F.substring("_body", F.lit(1), F.col("_comma") - 1)),
            "_data": F.when(F.col("_comma") > 0, F.expr("substring(_body, _comma + 1)")),
        }
    )
    df = df.withColumn("_bytes", F.when(F.col("_meta").contains("base64"), F.try_to_binary("_data", F.lit("base64"))))
    error = (
        F.when(F.col("_comma") == 0, "no comma before the payload")
        .when(~F.col("_meta").contains("base64"), "payload is not base64")
        .when(F.col("_bytes").isNull(), "payload cannot be decoded")
        .when(F.octet_length("_bytes") > F.lit(max_bytes), f"payload above {max_bytes} bytes")
    )
    df = df.withColumn("error", error).withColumn("content", F.when(F.col("error").isNull(), F.col("_bytes")))
    return df.drop("_meta", "_body", "_comma", "_data", "_bytes")


def read_pixels(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pre-decoded pixel table; other columns are not read."""
    if fmt == "csv":
        schema = "image_id string, idx bigint, x int, y int, r int, g int, b int, a int"
        return spark.read.schema(schema).csv(path, header=True)
    return spark.read.format(fmt).load(path).select(*PIXEL_COLUMNS)
