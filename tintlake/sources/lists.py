"""Colour lists: one colour per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_lines(lines: DataFrame, col: str) -> DataFrame:
    """Trim and drop blanks and comments: ``//...``, a lone ``#``, or ``#`` before white space."""
    trimmed = F.regexp_replace(F.col(col), r"^\s+|\s+$", "")
    text = F.col(col)
    return lines.withColumn(col, trimmed).filter((text != "") & ~text.startswith("//") & ~text.rlike(r"^#(\s|$)"))


def read_color_list(spark: SparkSession, path: str) -> DataFrame:
    """Colours of text files; no colour at all is an error."""
    rows = clean_lines(spark.read.text(path).withColumnRenamed("value", "raw"), "raw")
    if rows.isEmpty():
        raise ValueError("no color inputs")
    return rows
