"""Catalogue JSON: one wrapper object per document, schema fixed, unknown fields refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sinks import SCHEMA_NAME

WRAPPER_KEYS = ["schema", "palettes"]
PALETTE_KEYS = ["id", "name", "description", "categories", "tags", "colors", "source", "license"]
PALETTE_TYPE = (
    "struct<id:string,name:string,description:string,categories:array<string>,tags:array<string>,"
    "colors:array<string>,source:string,license:string>"
)


def parse_catalogues(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Split documents (doc, text) into palette rows (doc, pos, ...) and refused documents (doc, error).

    A document fails as a whole: malformed JSON, another schema name, or any unknown field.
    """
    allowed = lambda keys, names: F.size(F.array_except(keys, F.array(*[F.lit(n) for n in names]))) == 0
    df = docs.withColumn("_raw", F.from_json(text, "schema string, palettes array<string>"))
    df = df.withColumns({"_keys": F.json_object_keys(text), "_list": F.coalesce("_raw.palettes", F.array().cast("array<string>"))})
    error = (
        F.when(F.col("_keys").isNull(), "malformed")
        .when(~allowed(F.col("_keys"), WRAPPER_KEYS), "unknown field")
        .when(F.coalesce("_raw.schema", F.lit("")).isin("", SCHEMA_NAME) == F.lit(False), "unsupported schema")
        .when(F.exists("_list", lambda p: ~F.coalesce(allowed(F.json_object_keys(p), PALETTE_KEYS), F.lit(False))), "unknown field")
        .when(F.size("_list") == 0, "no palettes")
    )
    df = df.withColumn("error", error)
    rows = df.filter(F.col("error").isNull()).select("doc", F.posexplode("_list").alias("pos", "_p"))
    rows = rows.select("doc", "pos", F.from_json("_p", PALETTE_TYPE).alias("p")).select("doc", "pos", "p.*")
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, empty) for c in ("categories", "tags", "colors")})
    return rows, df.filter(F.col("error").isNotNull()).select("doc", "error")


def read_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Catalogue files under ``path``, each one JSON document."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))
    return parse_catalogues(docs)
