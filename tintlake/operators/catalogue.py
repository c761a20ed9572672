"""Palette-catalogue jobs: validation, categories, listing, search, appends.

A catalogue row is (pos, id, name, description, categories[], tags[], colors[]); ``pos`` is its place in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernel
from ..functions.parse import with_parsed
from ..runtime import TILE_ROWS, cut, dense_position, running_weight, salted_join, spread_by

SAVED = "Saved"
ID_RULE = "^[a-z0-9]+(-[a-z0-9]+)*$"


def category_slug(name: Column | str) -> Column:
    """Letters and digits in lower case, every other run one dash, none at the ends."""
    col = F.col(name) if isinstance(name, str) else name
    dashed = F.regexp_replace(col, r"[^\p{L}\p{Nd}]+", "-")
    return F.lower(F.regexp_replace(dashed, "^-+|-+$", ""))


def _trimmed(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")


def color_rows(catalogue: DataFrame) -> DataFrame:
    """Catalogue colours as rows (pos, id, name, ord, raw, r, g, b, a, notation, error)."""
    rows = catalogue.select("pos", "id", "name", F.posexplode("colors").alias("ord", "raw"))
    return with_parsed(rows, "raw")


def violations(catalogue: DataFrame) -> DataFrame:
    """All rule violations as rows (pos, rule, value); a clean catalogue yields none."""

    def flag(bad: Column, rule: str, value: Column) -> Column:
        return F.when(bad, F.struct(F.lit(rule).alias("rule"), value.cast("string").alias("value")))

    none = F.lit(None)
    blank = lambda x: F.regexp_replace(x, r"\s+", "") == ""
    own = F.array(
        flag(~F.col("id").rlike(ID_RULE), "bad id", F.col("id")),
        flag(_trimmed("name") == "", "no name", none),
        flag(F.size("categories") == 0, "no categories", none),
        flag(F.exists("categories", blank), "empty category", none),
        flag(F.exists("categories", lambda x: ~blank(x) & (category_slug(x) == "")), "category without slug", none),
        flag(F.size("colors") == 0, "no colors", none),
    )
    row_level = catalogue.select("pos", F.explode(F.filter(own, lambda x: x.isNotNull())).alias("v")).select("pos", "v.*")

    repeated = catalogue.groupBy("id").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    ids = salted_join(catalogue.select("pos", "id"), repeated, ["id"], F.col("pos")).filter("pos > _first")
    ids = ids.select("pos", F.lit("duplicate id").alias("rule"), F.col("id").alias("value"))

    colors = color_rows(catalogue).withColumn("raw", _trimmed("raw"))
    bad = colors.filter(F.col("error").isNotNull())
    bad = bad.select("pos", F.when(F.col("raw") == "", "empty color").otherwise("bad color").alias("rule"), F.col("raw").alias("value"))
    hexed = colors.filter(F.col("error").isNull())
    hexed = hexed.select("pos", "ord", "raw", kernel.hex_text(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("hex"))
    twice = hexed.groupBy("pos", "hex").agg(F.min("ord").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    again = salted_join(hexed, twice, ["pos", "hex"], F.col("ord")).filter("ord > _first")
    again = again.select("pos", F.lit("duplicate color").alias("rule"), F.col("raw").alias("value"))
    return row_level.unionByName(ids).unionByName(bad).unionByName(again)


def category_rows(catalogue: DataFrame) -> DataFrame:
    """(pos, slug, name): each slug once per palette, its first spelling there."""
    rows = catalogue.select("pos", F.posexplode("categories").alias("cpos", "name"))
    rows = rows.withColumn("name", _trimmed("name")).withColumn("slug", category_slug("name")).filter("slug <> ''")
    return rows.groupBy("pos", "slug").agg(F.min_by("name", "cpos").alias("name"), F.min("cpos").alias("cpos"))


def categories(catalogue: DataFrame) -> DataFrame:
    """(slug, name, count): the display name is the first seen in the file."""
    per = category_rows(catalogue).groupBy("slug")
    return per.agg(F.min_by("name", F.struct("pos", "cpos")).alias("name"), F.count("*").alias("count"))


def list_palettes(catalogue: DataFrame, category: str = "", tag: str = "") -> DataFrame:
    """Palettes of a category (slug or display name) whose tags contain the text, ignoring case."""
    out = catalogue
    if category.strip():
        slug = category_slug(F.lit(category.strip()))
        out = out.filter(F.exists("categories", lambda x: category_slug(x) == slug))
        if out.isEmpty():
            raise ValueError(f"unknown category {category!r}")
    if tag.strip():
        needle = tag.strip().lower()
        out = out.filter(F.exists("tags", lambda t: F.lower(t).contains(needle)))
    return out


def palettes_by_id(catalogue: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested ids with their palette, null where unknown."""
    return wanted.join(catalogue, "id", "left")


def tag_vocabulary(catalogue: DataFrame) -> DataFrame:
    return catalogue.select(F.explode("tags").alias("tag")).distinct()


def search(catalogue: DataFrame, category: str = "All", tag: str = "", text: str = "") -> DataFrame:
    """AND of exact display category, exact tag, and text inside name and description, ignoring case."""
    out = catalogue
    if category != "All":
        out = out.filter(F.array_contains("categories", category))
    if tag:
        out = out.filter(F.array_contains("tags", tag))
    needle = text.strip().lower()
    if needle:
        out = out.filter(searched_text().contains(needle))
    return out


def searched_text() -> Column:
    """Name and description as ``search`` reads them."""
    return F.lower(F.concat_ws(" ", "name", F.coalesce("description", F.lit(""))))


def palette_slots(catalogue: DataFrame) -> DataFrame:
    """Long palette table of a catalogue, with its origin."""
    rows = color_rows(catalogue)
    return rows.select("id", "name", "ord", "r", "g", "b", "a", "error", F.concat(F.lit("library:"), F.col("id")).alias("source"))


# --- appends ----------------------------------------------------------------------------------------------------


def id_slug(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(slug == "", "palette").otherwise(slug)


def _numbered(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """First free ids: rows (base, seq) in order get base, base-2, base-3, ..., leaving out taken ids.

    With the taken numbers of a base sorted as t0 < t1 < ..., a row of rank k receives k + 1 plus the count of
    t_i with t_i - i <= k + 1. Ranks and thresholds meet in one running count per base; both steps work bucket
    by bucket, so a name used by very many rows is spread over tasks.
    """
    number = F.regexp_extract("id", r"-([1-9]\d{0,17})$", 1)
    stem = F.regexp_replace("id", r"-[1-9]\d{0,17}$", "")
    as_is = taken.select(F.col("id").alias("base"), F.lit(1).cast("bigint").alias("t"))
    suffixed = taken.filter((number != "") & (number != "1")).select(stem.alias("base"), number.cast("bigint").alias("t"))
    held = as_is.unionByName(suffixed).join(rows.select("base").distinct(), "base", "left_semi").distinct()
    held = dense_position(held, ["base"], F.floor(F.col("t") / TILE_ROWS), ["t"], "i")
    marks = held.select("base", (F.col("t") - F.col("i")).alias("at"), F.lit(1).alias("hold"), F.lit(None).cast("bigint").alias("seq"))
    ranked = dense_position(rows, ["base"], F.floor(F.col("seq") / TILE_ROWS), ["seq"], "k")
    asks = ranked.select("base", (F.col("k") + 1).alias("at"), F.lit(0).alias("hold"), "seq")
    line = marks.unionByName(asks)
    # thresholds come before ranks of the same value
    line = line.withColumn("key", F.struct("at", (F.lit(1) - F.col("hold")).alias("after"), "seq"))
    line = running_weight(line, ["base"], "key", "hold", F.floor(F.col("at") / TILE_ROWS), "before")
    free = line.filter("hold = 0").select("base", "seq", (F.col("at") + F.col("before")).alias("n"))
    given = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string")))
    return free.select("seq", "base", given.alias("id"))


def _family(base: str) -> Column:
    """The name without its trailing numbers: ids that can ever meet are of one family."""
    return F.regexp_replace(base, r"(-[1-9]\d*)+$", "")


def generate_ids(fresh: DataFrame, taken: DataFrame) -> DataFrame:
    """Ids for (seq, name) as if saved one after another: rows (seq, id).

    Different bases can reach the same id ("a" third against "a 3" first). The earlier row keeps it; later ones
    are numbered again with that id taken, until none collides. Families of names cannot meet, so in a round every
    family settles its rows before its own first loser: rounds follow the clashes of one family, not their number.
    """
    rows = fresh.select("seq", id_slug(F.col("name")).alias("base"))
    settled, open_, held = None, rows, taken.select("id")
    while True:
        given = cut(_numbered(open_, held).withColumn("family", _family("base")))
        first = given.groupBy("id").agg(F.min("seq").alias("_first"), F.count("*").alias("_n"))
        clash = given.join(first.filter("_n > 1").select("id", "_first"), "id").filter("seq > _first")
        losers = cut(clash.groupBy("family").agg(F.min("seq").alias("_from")))
        if losers.isEmpty():
            done = given.select("seq", "id")
            return done if settled is None else settled.unionByName(done)
        marked = given.join(losers, "family", "left")
        # what a family saved before its first loser is final; its rest is numbered again
        final = marked.filter(F.col("_from").isNull() | (F.col("seq") < F.col("_from"))).select("seq", "id")
        settled = final if settled is None else settled.unionByName(final)
        held = cut(held.unionByName(final.select("id")))
        open_ = cut(open_.join(final.select("seq"), "seq", "left_anti"))


def append(catalogue: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Save rows (seq, name, description, categories, tags, colors) into the catalogue.

    Returns the grown catalogue and the refused rows with a reason. Colours become canonical hex, the category
    ``Saved`` always leads, categories and tags are trimmed.
    """
    # parsing is most of the work: the rows are dealt out first, as a small file comes in few tasks
    named = spread_by(fresh, "seq").withColumn("name", _trimmed("name"))
    parsed = with_parsed(named.select("seq", F.posexplode("colors").alias("ord", "raw")), "raw")
    code = kernel.hex_text(F.col("r"), F.col("g"), F.col("b"), F.col("a"))
    canon = parsed.groupBy("seq").agg(
        F.count_if(F.col("error").isNotNull()).alias("_bad"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", code.alias("hex")))), lambda x: x["hex"]).alias("hexes"),
    )
    ready = named.join(canon, "seq", "left")
    reason = (
        F.when(F.col("name") == "", "no palette name")
        .when(F.size("colors") == 0, "no colors")
        .when(F.col("_bad") > 0, "unreadable color")
        .when(F.size(F.array_distinct("hexes")) < F.size("hexes"), "duplicate color")
    )
    # numbering reads the good rows several times: their colours are parsed once
    ready = cut(ready.withColumn("error", reason))
    good = ready.filter(F.col("error").isNull())
    ids = generate_ids(good, catalogue)
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    kept = F.filter(F.transform(F.coalesce("categories", F.array().cast("array<string>")), strip), lambda x: (x != "") & (F.lower(x) != SAVED.lower()))
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), strip), lambda x: x != "")
    start = catalogue.agg(F.coalesce(F.max("pos"), F.lit(-1))).scalar()
    rows = good.join(ids.hint("merge"), "seq").select(
        (F.col("seq") + start + 1).cast("bigint").alias("pos"), "id", "name", _trimmed("description").alias("description"),
        F.concat(F.array(F.lit(SAVED)), kept).alias("categories"), tags.alias("tags"), F.col("hexes").alias("colors"),
    )
    return catalogue.unionByName(rows), ready.filter(F.col("error").isNotNull()).select("seq", "error")


def load_or_default(spark: SparkSession, path: str | None, default: DataFrame) -> DataFrame:
    """An external catalogue replaces the default as a whole; a missing one falls back to it.

    It has the default's columns. A document in it that cannot be read fails the load: a catalogue without some of its
    palettes would pass for whole.
    """
    from pyspark.errors import AnalysisException

    from ..sources.catalogue import read_catalogue

    if not path:
        return default
    try:
        good, bad = read_catalogue(spark, path)
        refused = bad.limit(5).collect()
        if refused:
            raise ValueError(f"{path} has documents that cannot be read: {[r.asDict() for r in refused]}")
        return good.select(*default.columns)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return default
