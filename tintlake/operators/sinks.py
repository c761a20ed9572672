"""Publishing jobs: text and JSON forms of palettes, gradients and lattices, and their partitioned writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernel
from ..runtime import salted_join
from .enrich import notation_text, with_spaces

SCHEMA_NAME = "tintlake/v1"
LATTICE_FOLDERS = 64


def _capped(v: Column, top: int, scale: float) -> Column:
    return F.floor(F.least(F.greatest(v * scale, kernel.lit(0)), kernel.lit(top)) + 0.5).cast("int")


def _ordered(slots: DataFrame, key: str, fields: Column, name: str) -> DataFrame:
    """Slots of one palette as an array in slot order: a document is one value. ``token_lines`` gives lines instead."""
    pairs = F.collect_list(F.struct(F.col("ord"), fields.alias("v")))
    return slots.groupBy(key).agg(F.transform(F.array_sort(pairs), lambda p: p["v"]).alias(name), F.count("*").alias("size"))


def with_forms(slots: DataFrame) -> DataFrame:
    """Slots with the spaces that ``colour_forms`` reads."""
    return kernel.with_oklch(kernel.with_hsv(kernel.with_hsl(slots)))


def colour_forms() -> Column:
    """A colour's integer forms; ``rgba`` is null on opaque colours."""
    ints = F.array
    return F.struct(
        kernel.hex_text(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("hex"),
        ints("r", "g", "b").alias("rgb"),
        F.when(F.col("a") != 255, ints("r", "g", "b", "a")).alias("rgba"),
        ints(_capped(F.col("hsl_h"), 360, 1), _capped(F.col("hsl_s"), 100, 100), _capped(F.col("hsl_l"), 100, 100)).alias("hsl"),
        ints(_capped(F.col("hsv_h"), 360, 1), _capped(F.col("hsv_s"), 100, 100), _capped(F.col("hsv_v"), 100, 100)).alias("hsv"),
        ints(_capped(F.col("ok_l"), 100, 100), _capped(F.col("ok_c"), 100, 100), _capped(F.col("ok_h"), 360, 1)).alias("oklch"),
    )


def envelopes(slots: DataFrame, tool: str | None = None, params: dict[str, str] | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """One JSON document per palette_id: schema, tool, params, result.palette with integer colour forms.

    Optional members are left out when absent; ``rgba`` appears only on translucent colours. ``metadata`` may
    hold (palette_id, metadata struct).
    """
    docs = _ordered(with_forms(slots), "palette_id", colour_forms(), "colors")
    result = [F.struct(F.col("size"), F.col("colors")).alias("palette")]
    if metadata is not None:
        docs = docs.join(metadata, "palette_id", "left")
        result.append(F.col("metadata"))
    parts = [F.lit(SCHEMA_NAME).alias("schema")]
    if tool:
        parts.append(F.lit(tool).alias("tool"))
    if params:
        parts.append(F.struct(*[F.lit(v).alias(k) for k, v in params.items()]).alias("params"))
    return docs.select("palette_id", F.to_json(F.struct(*parts, F.struct(*result).alias("result"))).alias("document"))


def token_lines(slots: DataFrame, prefix: str = "color", notation: str = "hex") -> DataFrame:
    """One CSS variable line per colour as rows (palette_id, pos, line), for palettes of any size."""
    df = slots if notation in ("hex", "hex-upper", "rgb", "int") else with_spaces(slots)
    line = F.format_string(f"  --{prefix}-%d: %s;", F.col("ord") + 1, notation_text(notation))
    return df.select("palette_id", F.col("ord").alias("pos"), line.alias("line"))


TOKEN_FORMATS = ["css", "scss", "less", "plain", "gpl", "tailwind"]


def token_texts(prefix: str, nr: Column) -> dict[str, Column]:
    """Text of one colour (r, g, b, value) in every format, line end included."""
    fmt = F.format_string
    return {
        "css": fmt(f"  --{prefix}-%d: %s;\n", nr, "value"),
        "scss": fmt(f"${prefix}-%d: %s;\n", nr, "value"),
        "less": fmt(f"@{prefix}-%d: %s;\n", nr, "value"),
        "plain": fmt("%s\n", "value"),
        "gpl": fmt(f"%3d %3d %3d\t{prefix}-%d\n", "r", "g", "b", nr),
        "tailwind": fmt(f'  "{prefix}-%d": "%s",\n', nr, "value"),
    }


def design_tokens(slots: DataFrame, prefix: str = "color", notation: str = "hex", formats: list[str] | None = None) -> DataFrame:
    """Token text of every palette in every format: rows (palette_id, format, text)."""
    if notation in ("hex", "hex-upper", "rgb", "int"):
        df = slots
    else:
        df = with_spaces(slots)
    df = df.select("palette_id", "ord", "r", "g", "b", notation_text(notation).alias("value"))
    nr = F.col("ord") + 1
    per = token_texts(prefix, nr)
    chosen = formats or TOKEN_FORMATS
    fields = F.struct(*[per[f].alias(f) for f in chosen], nr.alias("nr"))
    docs = _ordered(df, "palette_id", fields, "rows")

    def body(f: str) -> Column:
        return F.array_join(F.transform("rows", lambda x: x[f]), "")

    def listing(sign: str) -> Column:
        return F.array_join(F.transform("rows", lambda x: F.concat(F.lit(f"{sign}{prefix}-"), x["nr"].cast("string"))), ", ")

    whole = {
        "css": lambda: F.concat(F.lit(":root {\n"), body("css"), F.lit("}\n")),
        "scss": lambda: F.concat(body("scss"), F.lit(f"\n${prefix}-list: ("), listing("$"), F.lit(");\n")),
        "less": lambda: F.concat(body("less"), F.lit(f"\n@{prefix}-list: "), listing("@"), F.lit(";\n")),
        "plain": lambda: body("plain"),
        "gpl": lambda: F.concat(F.lit(f"GIMP Palette\nName: {prefix}\nColumns: 0\n#\n"), body("gpl")),
        "tailwind": lambda: F.concat(F.lit("module.exports = {\n"), body("tailwind"), F.lit("};\n")),
    }
    entries = F.array(*[F.struct(F.lit(f).alias("format"), whole[f]().alias("text")) for f in chosen])
    return docs.select("palette_id", F.inline(entries))


def gradient_segments(slots: DataFrame) -> DataFrame:
    """Colours of a palette as max(n - 1, 1) even segments (left, mid, right, both colours)."""
    n = slots.groupBy("palette_id").agg(F.count("*").alias("n"))
    nxt = slots.select("palette_id", (F.col("ord") - 1).alias("ord"), *[F.col(c).alias(f"{c}1") for c in "rgb"])
    df = salted_join(slots.select("palette_id", "ord", "r", "g", "b"), n, ["palette_id"], F.col("ord"))
    df = df.join(nxt, ["palette_id", "ord"], "left").filter(F.col("r1").isNotNull() | (F.col("n") == 1))
    segs = F.greatest(F.col("n") - 1, F.lit(1)).cast("double")
    df = df.withColumns({"left": F.col("ord") / segs, "right": (F.col("ord") + 1) / segs})
    ends = [F.coalesce(f"{c}1", c).alias(f"{c}1") for c in "rgb"]
    return df.select("palette_id", "ord", "left", ((F.col("left") + F.col("right")) / 2).alias("mid"), "right", "r", "g", "b", *ends)


def css_stop() -> Column:
    return F.format_string("%s %.1f%%", kernel.hex_text(F.col("r"), F.col("g"), F.col("b")), F.col("pos") * 100.0)


def css_gradients(stops: DataFrame, space: str = "oklab") -> DataFrame:
    """``linear-gradient(in <space> 90deg, hex p%, ...)`` per ramp from positioned stops."""
    from .gradient import CSS_SPACE

    rows = _ordered(stops, "ramp_id", css_stop(), "parts")
    text = F.concat(F.lit(f"linear-gradient(in {CSS_SPACE[space]} 90deg, "), F.array_join("parts", ", "), F.lit(")"))
    return rows.select("ramp_id", text.alias("css"))


_UNITS = "array(" + ",".join(f"'{v / 255:.6f}'" for v in range(256)) + ")"


def lattice_line(r: Column, g: Column, b: Column) -> Column:
    """Text of a node: three of the 256 texts of a byte."""
    return F.concat_ws(" ", *[F.get(F.expr(_UNITS), c.cast("int")) for c in (r, g, b)])


def lattice_lines(lattice: DataFrame) -> DataFrame:
    """Lattice text lines per palette: a size header at pos -1, then one line per node, red fastest."""
    line = lattice_line(*[F.col(c) for c in "rgb"])
    rows = lattice.select("palette_id", F.col("node").alias("pos"), line.alias("line"))
    head = lattice.select("palette_id", "size").distinct()
    head = head.select("palette_id", F.lit(-1).alias("pos"), F.format_string("LUT_3D_SIZE %d", "size").alias("line"))
    return head.unionByName(rows)


# --- writes -------------------------------------------------------------------------------------------------


def write_documents(docs: DataFrame, path: str, column: str = "document", by: str | None = None, key: str = "palette_id") -> None:
    """JSON lines, one record a document: its palette id and its text; ``by`` partitions the output folder."""
    record = F.to_json(F.struct(F.col(key), F.col(column).alias("document"))).alias("value")
    writer = docs.select(*([by] if by else []), record).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)


def write_lattices(lattice: DataFrame, path: str) -> None:
    """Tab-separated palette id and line, a palette's lines together in node order, in folders of hashed ids: as many as
    ``LATTICE_FOLDERS``, however many palettes there are."""
    lines = lattice_lines(lattice).withColumn("bucket", F.pmod(F.xxhash64("palette_id"), F.lit(LATTICE_FOLDERS)))
    lines = lines.repartition("bucket").sortWithinPartitions("bucket", "palette_id", "pos")
    value = F.concat_ws("\t", F.col("palette_id").cast("string"), "line").alias("value")
    lines.select("bucket", value).write.mode("overwrite").partitionBy("bucket").text(path)
