"""Substring search in written catalogues through trigram postings.

An index is two tables below one folder: ``palettes``, the catalogue in partitions of consecutive positions, and
``postings``, one row per (field, trigram, palette), sorted so that a trigram's rows lie together and the scan skips
the others. A search reads the postings of its trigrams, keeps the palettes that have all of them, reads only their
partitions (dynamic pruning) and hands what is left to the plain search, which decides. A text of less than three
letters has no trigram and goes to the plain search at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue as cg

# Positions of one partition of the palettes.
BLOCK = 1 << 16
TAGS, TEXT = "tags", "text"


def trigrams(text: Column) -> Column:
    """Distinct runs of three letters; null for a null text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def postings(catalogue: DataFrame) -> DataFrame:
    """(field, gram, pos, block): trigrams of the lower-cased tags, and of name and description as they are searched."""
    tags = F.array_distinct(F.flatten(F.transform(F.filter("tags", lambda t: t.isNotNull()), lambda t: trigrams(F.lower(t)))))
    fields = {TAGS: tags, TEXT: trigrams(cg.searched_text())}
    of = [F.struct(F.lit(name).alias("field"), F.coalesce(grams, F.array().cast("array<string>")).alias("grams")) for name, grams in fields.items()]
    rows = catalogue.select("pos", F.explode(F.array(*of)).alias("f"))
    return rows.select("f.field", F.explode("f.grams").alias("gram"), "pos", _block())


def _block() -> Column:
    return F.floor(F.col("pos") / BLOCK).alias("block")


def write_index(catalogue: DataFrame, folder: str) -> None:
    """Write the palettes and postings of a catalogue below ``folder``, which must not exist yet."""
    catalogue.select("*", _block()).repartition("block").write.partitionBy("block").parquet(f"{folder}/palettes")
    # the position is part of the range, so that a trigram of very many palettes is spread over files
    order = ["field", "gram", "pos"]
    postings(catalogue).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{folder}/postings")


def narrowed(palettes: DataFrame, folder: str, field: str, needle: Column) -> DataFrame:
    """Palettes whose field has all trigrams of the constant (lower-cased) needle: all that hold it are among them."""
    spark = palettes.sparkSession
    grams = spark.range(1).select(trigrams(needle)).first()[0]
    if not grams:
        return palettes
    rows = spark.read.parquet(f"{folder}/postings").filter((F.col("field") == field) & F.col("gram").isin(grams))
    hits = rows.groupBy("block", "pos").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
    return palettes.join(hits, ["block", "pos"], "left_semi")


def _palettes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/palettes")


def list_palettes(spark: SparkSession, folder: str, category: str = "", tag: str = "") -> DataFrame:
    """``catalogue.list_palettes`` over an index."""
    out = cg.list_palettes(_palettes(spark, folder), category)
    return cg.list_palettes(narrowed(out, folder, TAGS, F.lit(tag.strip().lower())), tag=tag).drop("block")


def search(spark: SparkSession, folder: str, category: str = "All", tag: str = "", text: str = "") -> DataFrame:
    """``catalogue.search`` over an index: the exact tag and the text both narrow the palettes that are read."""
    out = narrowed(_palettes(spark, folder), folder, TAGS, F.lower(F.lit(tag)))
    out = narrowed(out, folder, TEXT, F.lit(text.strip().lower()))
    return cg.search(out, category, tag, text).drop("block")
