import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoints-"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_pixels(spark):
    """Pixel table of one or more images given as {image_id: (width, [(r, g, b, a), ...])}."""

    def build(images):
        rows = [
            (image_id, i, i % width, i // width, *pixel)
            for image_id, (width, pixels) in images.items()
            for i, pixel in enumerate(pixels)
        ]
        return spark.createDataFrame(rows, "image_id bigint, idx bigint, x int, y int, r int, g int, b int, a int")

    return build
