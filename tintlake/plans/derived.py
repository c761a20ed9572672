"""Colour views derived from the test tables, as DataFrames and as the equal SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import dense_position, join_image_facts

WIDTH = 24
BASES = [(220, 40, 50), (30, 90, 200), (215, 200, 60), (40, 150, 90), (128, 128, 128), (20, 20, 30)]
# Orders per ranking bucket: bounds how many rows of one image a single task sorts.
ORDER_BUCKET = 1 << 18


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ints(df: DataFrame, **cols: str) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in cols.items()])


def _channel(i: int, spread: str) -> str:
    base = "element_at(array(" + ",".join(str(c[i]) for c in BASES) + "), cast((l_partkey + l_linenumber) % 6 as int) + 1)"
    return f"cast({base} + ({spread}) % 23 as int)"


PIXEL_COLS = {
    "image_id": "l_suppkey",
    "r": _channel(0, "l_partkey * 7 + l_linenumber * 3"),
    "g": _channel(1, "l_partkey * 5 + l_linenumber * 11"),
    "b": _channel(2, "l_partkey * 3 + l_orderkey * 13"),
    "a": "case when l_orderkey % 17 = 0 then 0 else 255 end",
}


def colours(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels without raster position, for jobs that do not need the order."""
    return ints(table(spark, sf, "lineitem"), **PIXEL_COLS)


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels (image_id, idx, x, y, r, g, b, a) in dense raster order, rows of 24."""
    placed = dense_position(
        table(spark, sf, "lineitem"),
        ["l_suppkey"],
        F.floor(F.col("l_orderkey") / ORDER_BUCKET),
        ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"],
        "idx",
    )
    return ints(
        placed,
        image_id=PIXEL_COLS["image_id"],
        idx="idx",
        x=f"cast(idx % {WIDTH} as int)",
        y=f"cast(idx div {WIDTH} as int)",
        **{c: PIXEL_COLS[c] for c in "rgba"},
    )


def images(spark: SparkSession, sf: str) -> DataFrame:
    """One row per image: total pixels and size."""
    n = colours(spark, sf).groupBy("image_id").agg(F.count("*").alias("n_total"))
    return n.withColumns({"w": F.lit(WIDTH), "h": F.ceil(F.col("n_total") / WIDTH).cast("int")})


def _sql_case(i: int) -> str:
    return "case (l_partkey + l_linenumber) % 6 " + " ".join(f"when {n} then {c[i]}" for n, c in enumerate(BASES)) + " end"


PIXELS_SQL = f"""pixels as (
 select image_id, idx, cast(idx % {WIDTH} as int) as x, cast(idx // {WIDTH} as int) as y, r, g, b, a from (
  select l_suppkey as image_id,
   row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 as idx,
   cast({_sql_case(0)} + (l_partkey*7 + l_linenumber*3) % 23 as int) as r,
   cast({_sql_case(1)} + (l_partkey*5 + l_linenumber*11) % 23 as int) as g,
   cast({_sql_case(2)} + (l_partkey*3 + l_orderkey*13) % 23 as int) as b,
   case when l_orderkey % 17 = 0 then 0 else 255 end as a
  from lineitem)),
 images as (select image_id, count(*) as n_total, {WIDTH} as w, cast(ceil(count(*) / {WIDTH}e0) as int) as h from pixels group by image_id)"""

# --- colour strings ---------------------------------------------------------------------------------------


def color_strings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")

    def m(mult: int, add: int, mod: int) -> Column:
        return ((k * mult + add) % mod).cast("int")

    r, g, b = m(37, 11, 256), m(101, 40, 256), m(53, 7, 256)
    fmt = F.format_string
    kinds = [
        fmt("#%02x%02x%02x", r, g, b),
        fmt(" #%X%X%X ", m(7, 1, 16), m(5, 2, 16), m(3, 3, 16)),
        fmt("rgb(%d, %d, %d)", r, g, b),
        fmt("RGBA(%d %d %d / 50%%)", r, g, b),
        F.split("p_name", " ")[0],
        fmt("hsl(%ddeg %d%% %d%%)", m(37, 0, 360), m(13, 5, 101), m(29, 3, 101)),
        fmt("%02x%02x%02x", r, g, b),
        fmt("#%dzz", m(1, 0, 10)),
        fmt("oklch(0.%d 0.%02d %d)", m(7, 2, 10), m(11, 1, 30), m(41, 0, 360)),
        fmt("lab(%d %d %d)", m(17, 2, 101), m(19, 0, 121) - 60, m(23, 0, 121) - 60),
        fmt("hsv(%d %d%% %d%%)", m(31, 0, 360), m(13, 5, 101), m(29, 3, 101)),
        F.lit("rebecca-purple"),
        fmt("hls(0.%d %d%% %d%%)", m(3, 1, 10), m(13, 5, 101), m(29, 3, 101)),
        fmt("rgb(%d, %d)", r, g),
        fmt("lch(%d%% %d %ddeg)", m(17, 2, 101), m(19, 0, 100), m(43, 5, 360)),
        fmt("oklab(%d%% 0.%d -0.0%d)", m(17, 2, 101), m(3, 1, 3), m(5, 0, 10)),
    ]
    raw = kinds[-1]
    for i in reversed(range(len(kinds) - 1)):
        raw = F.when(k % len(kinds) == i, kinds[i]).otherwise(raw)
    return table(spark, sf, "part").select(k.alias("id"), raw.alias("raw"))


def _m(mult: int, add: int, mod: int) -> str:
    return f"cast((p_partkey*{mult}+{add})%{mod} as int)"


_RGB = f"{_m(37, 11, 256)}, {_m(101, 40, 256)}, {_m(53, 7, 256)}"
_KINDS = [
    f"printf('#%02x%02x%02x', {_RGB})",
    f"printf(' #%X%X%X ', {_m(7, 1, 16)}, {_m(5, 2, 16)}, {_m(3, 3, 16)})",
    f"printf('rgb(%d, %d, %d)', {_RGB})",
    f"printf('RGBA(%d %d %d / 50%%)', {_RGB})",
    "string_split(p_name, ' ')[1]",
    f"printf('hsl(%ddeg %d%% %d%%)', {_m(37, 0, 360)}, {_m(13, 5, 101)}, {_m(29, 3, 101)})",
    f"printf('%02x%02x%02x', {_RGB})",
    f"printf('#%dzz', {_m(1, 0, 10)})",
    f"printf('oklch(0.%d 0.%02d %d)', {_m(7, 2, 10)}, {_m(11, 1, 30)}, {_m(41, 0, 360)})",
    f"printf('lab(%d %d %d)', {_m(17, 2, 101)}, {_m(19, 0, 121)}-60, {_m(23, 0, 121)}-60)",
    f"printf('hsv(%d %d%% %d%%)', {_m(31, 0, 360)}, {_m(13, 5, 101)}, {_m(29, 3, 101)})",
    "'rebecca-purple'",
    f"printf('hls(0.%d %d%% %d%%)', {_m(3, 1, 10)}, {_m(13, 5, 101)}, {_m(29, 3, 101)})",
    f"printf('rgb(%d, %d)', {_m(37, 11, 256)}, {_m(101, 40, 256)})",
    f"printf('lch(%d%% %d %ddeg)', {_m(17, 2, 101)}, {_m(19, 0, 100)}, {_m(43, 5, 360)})",
    f"printf('oklab(%d%% 0.%d -0.0%d)', {_m(17, 2, 101)}, {_m(3, 1, 3)}, {_m(5, 0, 10)})",
]
COLOR_STRINGS_SQL = (
    "color_strings as (select p_partkey as id, case p_partkey % 16 "
    + " ".join(f"when {i} then {k}" for i, k in enumerate(_KINDS))
    + " end as raw from part)"
)

# --- palettes, pairs, bases ---------------------------------------------------------------------------------
# Customers of one nation fill palettes of eight slots each, in key order.


def _slots(spark: SparkSession, sf: str) -> DataFrame:
    """Customers numbered inside their nation."""
    return dense_position(
        table(spark, sf, "customer"), ["c_nationkey"], F.floor(F.col("c_custkey") / ORDER_BUCKET), ["c_custkey"], "slot"
    )


def palettes(spark: SparkSession, sf: str) -> DataFrame:
    """All customers as palette slots: palette_id = nation + 100 * (slot div 8), ord = slot mod 8."""
    return ints(
        _slots(spark, sf),
        palette_id="cast(c_nationkey + 100 * (slot div 8) as bigint)",
        ord="cast(slot % 8 as int)",
        r="cast(c_custkey*37 % 256 as int)",
        g="cast(c_custkey*101 % 256 as int)",
        b="cast(c_custkey*53 % 256 as int)",
        a="cast(case when c_custkey % 10 = 0 then 128 else 255 end as int)",
    )


PALETTES_SQL = """palettes as (
 select cast(c_nationkey + 100 * (slot // 8) as bigint) as palette_id, cast(slot % 8 as int) as ord,
  cast(c_custkey*37 % 256 as int) as r, cast(c_custkey*101 % 256 as int) as g, cast(c_custkey*53 % 256 as int) as b,
  case when c_custkey % 10 = 0 then 128 else 255 end as a
 from (select *, row_number() over (partition by c_nationkey order by c_custkey) - 1 as slot from customer))"""

PAIR_COLS = {
    "pair_id": "c_custkey",
    "fr": "cast(c_custkey*37 % 256 as int)",
    "fg": "cast(c_custkey*101 % 256 as int)",
    "fb": "cast(c_custkey*53 % 256 as int)",
    "br": "cast((c_custkey*17+90) % 256 as int)",
    "bg": "cast((c_custkey*71+40) % 256 as int)",
    "bb": "cast((c_custkey*29+200) % 256 as int)",
}


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return ints(table(spark, sf, "customer"), **PAIR_COLS, category="c_mktsegment", palette_id="c_nationkey")


PAIRS_SQL = (
    "pairs as (select "
    + ", ".join(f"{e} as {n}" for n, e in PAIR_COLS.items())
    + ", c_mktsegment as category, c_nationkey as palette_id from customer)"
)

BASE_COLS = {
    "base_id": "s_suppkey",
    "r": "cast(s_suppkey*67 % 256 as int)",
    "g": "cast((s_suppkey*31+80) % 256 as int)",
    "b": "cast((s_suppkey*113+20) % 256 as int)",
}


def bases(spark: SparkSession, sf: str) -> DataFrame:
    return ints(table(spark, sf, "supplier"), **BASE_COLS)


BASES_SQL = "bases as (select " + ", ".join(f"{e} as {n}" for n, e in BASE_COLS.items()) + " from supplier)"

# --- gradient stops: every part is a stop, five to a ramp ------------------------------------------------------

STOP_COLS = {
    "ramp_id": "p_partkey {div} 5",
    "ord": "cast(p_partkey % 5 as int)",
    "r": "cast(p_partkey*43 % 256 as int)",
    "g": "cast((p_partkey*19+60) % 256 as int)",
    "b": "cast((p_partkey*87+10) % 256 as int)",
    "pos": "(p_partkey % 5) * (p_partkey % 5) / 16e0",
}


def stops(spark: SparkSession, sf: str) -> DataFrame:
    return ints(table(spark, sf, "part"), **{n: e.format(div="div") for n, e in STOP_COLS.items()})


STOPS_SQL = "stops as (select " + ", ".join(f"{e.format(div='//')} as {n}" for n, e in STOP_COLS.items()) + " from part)"

# --- catalogue: one palette per supplier, with injected violations -------------------------------------------------


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """id, pos, name, description, categories[], tags[], colors[] with every kind of violation present."""
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")

    def colour(mult: int, add: int) -> Column:
        v = (k * mult + add) % 256
        return F.format_string("#%02x%02x%02x", v, (v * 7 + 5) % 256, (v * 11 + 9) % 256)

    c0, c1, c2 = colour(67, 3), colour(31, 80), colour(113, 20)
    empty = F.array().cast("array<string>")
    return joined.select(
        k.alias("pos"),
        F.when(k % 23 == 5, F.upper(F.regexp_replace("s_name", "#", "-")))
        .when(k % 29 == 6, F.format_string("dup-%d", (k / 58).cast("int")))
        .otherwise(F.format_string("pal-%d", k))
        .alias("id"),
        F.when(k % 31 == 7, F.lit("  ")).otherwise(F.concat(F.lit("Set "), F.col("n_name"))).alias("name"),
        F.concat(F.lit("Made in "), F.col("r_name")).alias("description"),
        F.when(k % 37 == 8, empty)
        .when(k % 41 == 9, F.array(F.col("r_name"), F.lit(" ")))
        .when(k % 43 == 10, F.array(F.lit("&&")))
        .otherwise(F.array(F.col("r_name"), F.lower("r_name"), F.format_string("Tone & %d", k % 4)))
        .alias("categories"),
        F.array(F.lower("r_name"), F.format_string("n%d", F.col("n_nationkey") % 3)).alias("tags"),
        F.when(k % 47 == 11, empty)
        .when(k % 19 == 4, F.array(c0, c1, F.concat(F.lit(" "), F.upper(c0))))
        .when(k % 17 == 3, F.array(c0, F.lit(""), F.lit("#zzz")))
        .otherwise(F.array(c0, c1, c2, F.lit("tomato")))
        .alias("colors"),
    )


def _sql_colour(mult: int, add: int) -> str:
    v = f"((s_suppkey*{mult}+{add})%256)"
    return f"printf('#%02x%02x%02x', {v}, ({v}*7+5)%256, ({v}*11+9)%256)"


CATALOGUE_SQL = f"""catalogue as (select s_suppkey as pos,
  case when s_suppkey % 23 = 5 then upper(replace(s_name, '#', '-')) when s_suppkey % 29 = 6 then printf('dup-%d', s_suppkey // 58)
   else printf('pal-%d', s_suppkey) end as id,
  case when s_suppkey % 31 = 7 then '  ' else 'Set ' || n_name end as name,
  'Made in ' || r_name as description,
  case when s_suppkey % 37 = 8 then []::varchar[] when s_suppkey % 41 = 9 then [r_name, ' '] when s_suppkey % 43 = 10 then ['&&']
   else [r_name, lower(r_name), printf('Tone & %d', s_suppkey % 4)] end as categories,
  [lower(r_name), printf('n%d', n_nationkey % 3)] as tags,
  case when s_suppkey % 47 = 11 then []::varchar[] when s_suppkey % 19 = 4 then [c0, c1, ' ' || upper(c0)] when s_suppkey % 17 = 3 then [c0, '', '#zzz']
   else [c0, c1, c2, 'tomato'] end as colors
 from (select *, {_sql_colour(67, 3)} as c0, {_sql_colour(31, 80)} as c1, {_sql_colour(113, 20)} as c2 from supplier)
 join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def sql(views: str, body: str) -> str:
    """``with`` the named views, then ``body``."""
    texts = {
        "pixels": PIXELS_SQL,
        "color_strings": COLOR_STRINGS_SQL,
        "palettes": PALETTES_SQL,
        "pairs": PAIRS_SQL,
        "bases": BASES_SQL,
        "stops": STOPS_SQL,
        "catalogue": CATALOGUE_SQL,
    }
    parts = [texts[v] for v in views.split()]
    return "with " + ",\n".join(parts) + "\n" + body.lstrip()


__all__ = ["bases", "catalogue", "color_strings", "colours", "images", "join_image_facts", "pairs", "palettes", "pixels", "sql", "stops", "table"]
