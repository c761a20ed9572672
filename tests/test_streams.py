import os
import random

import pytest
from pyspark.sql import functions as F

from tintlake.operators import pixels as px
from tintlake.operators import quantise as qz
from tintlake.streaming import histograms as sh

SCHEMA = "image_id bigint, r int, g int, b int"


def rows_of(df):
    return sorted(map(repr, df.collect()))


def some_pixels(seed, n, images):
    r = random.Random(seed)
    return [(r.choice(images), *(r.choice([0, 9, 120, 250]) + r.randint(0, 5) for _ in range(3))) for _ in range(n)]


def land(spark, folders, rows, files):
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("append").parquet(folders["in"])


def stream(spark, folders):
    return sh.arriving(spark, folders["in"], spark.createDataFrame([], SCHEMA).schema, 1)


def agree(spark, folders):
    every = spark.read.schema(SCHEMA).parquet(folders["in"])
    assert rows_of(sh.streamed_histogram(spark, folders["check"])) == rows_of(px.histogram(every))
    assert rows_of(sh.streamed_popularity(spark, folders["check"], 3)) == rows_of(qz.popularity(every, 3))


@pytest.fixture
def folders(tmp_path):
    return {name: str(tmp_path / name) for name in ("in", "check")}


def test_stop_restart_and_late_files(spark, folders):
    land(spark, folders, some_pixels(1, 400, [1, 2]), 3)
    sh.stream_bins(stream(spark, folders), folders["check"]).awaitTermination()
    agree(spark, folders)
    # late pixels of image 1, a new image, and null channels
    land(spark, folders, [*some_pixels(2, 200, [1, 7]), (1, None, 3, 4), (None, 5, 3, 4), (1, None, 3, 4)], 2)
    running = sh.stream_bins(stream(spark, folders), folders["check"], every="1 second")
    running.processAllAvailable()
    running.stop()
    agree(spark, folders)
    # nothing new: a restart changes nothing
    sh.stream_bins(stream(spark, folders), folders["check"]).awaitTermination()
    agree(spark, folders)


def test_failed_batch_runs_again(spark, folders):
    """A stream that breaks at its second file counts every pixel once after the restart."""
    land(spark, folders, some_pixels(3, 200, [1, 2]), 1)
    land(spark, folders, some_pixels(4, 100, [2, 9]), 1)
    lost = F.when(F.col("image_id") == 9, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("r"))
    with pytest.raises(Exception, match="lost"):
        sh.stream_bins(stream(spark, folders).withColumn("r", lost), folders["check"]).awaitTermination()
    sh.stream_bins(stream(spark, folders), folders["check"]).awaitTermination()
    agree(spark, folders)


def test_batch_without_commit_runs_again(spark, folders):
    """A batch whose state was written but whose end was not noted is repeated on the state before it."""
    land(spark, folders, some_pixels(5, 200, [1]), 1)
    land(spark, folders, some_pixels(6, 100, [1, 2]), 1)
    sh.stream_bins(stream(spark, folders), folders["check"]).awaitTermination()
    commits = os.path.join(folders["check"], "commits")
    last = max(name for name in os.listdir(commits) if name.isdigit())
    for name in (last, f".{last}.crc"):
        os.remove(os.path.join(commits, name))
    sh.stream_bins(stream(spark, folders), folders["check"]).awaitTermination()
    agree(spark, folders)
