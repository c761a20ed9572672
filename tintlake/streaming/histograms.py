"""Colour bins of arriving pixels: a mergeable histogram as streaming state, readable at any time.

The state of the stream is one row of sums per (image, bin), at most 32,768 bins an image at five bits, spread over the
shuffle width by image and bin, so a large image is no single state. A pixel may arrive at any time: sums only grow, no
watermark closes an image. Nothing but the state is written; it lies in the checkpoint folder, is committed batch by
batch, and is read with Spark's ``statestore`` source, so a batch that failed and runs again counts each pixel once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pixels import bin_means, bin_sums
from ..operators.quantise import fullest_bins

# The aggregates of ``bin_sums`` in their order, which is that of the state's values.
SUMS = "struct<n:bigint,sr:bigint,sg:bigint,sb:bigint,sq:bigint>"


def arriving(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files below ``path`` as a stream, at most ``max_files`` a micro-batch."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_bins(pixels: DataFrame, checkpoint: str, bits: int = 5, group: str = "image_id", every: str | None = None) -> StreamingQuery:
    """Start the histogram of a stream of pixels (``group``, r, g, b).

    ``checkpoint`` is a folder that all executors reach; the state lies there and a stream that is started again goes
    on from it. Without ``every`` (a trigger interval such as ``"1 minute"``) the stream takes what has arrived and
    ends. Null channels and images count as in the batch histogram.
    """
    writer = bin_sums(pixels, bits, (group,)).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def streamed_bins(spark: SparkSession, checkpoint: str, group: str = "image_id") -> DataFrame:
    """Sums of every bin after the last committed batch: (``group``, key, n, sr, sg, sb, sq)."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(f"key.{group}", "key.key", F.col("value").cast(SUMS).alias("value")).select(group, "key", "value.*")


def streamed_histogram(spark: SparkSession, checkpoint: str, group: str = "image_id") -> DataFrame:
    """Count and floor-mean colour of every bin, as ``pixels.histogram`` gives them for the same pixels at once."""
    return bin_means(streamed_bins(spark, checkpoint, group), (group,))


def streamed_popularity(spark: SparkSession, checkpoint: str, k: int, group: str = "image_id") -> DataFrame:
    """The k fullest bins of every image so far, as ``quantise.popularity`` gives them."""
    return fullest_bins(streamed_histogram(spark, checkpoint, group), k, group)
