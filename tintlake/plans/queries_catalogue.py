"""Catalogue, source and publishing queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalogue as cg
from ..operators import lut
from ..operators import postings as po
from ..operators import publish as pb
from ..operators import sinks
from ..runtime import cut, ensure_checkpoint_dir, spread_by
from ..sources import catalogue as src
from ..sources import images as im
from ..sources import lists
from ..sources import rasters as rs
from ..sources.files import read_files
from . import derived as d
from . import oracle as o
from .derived import sql
from .queries_color import _TEXT_SQL, _spaces_sql, micro
from .registry import query

# --- sources ------------------------------------------------------------------------------------------------

# The pixel table as raster files: an image's last row is filled up with transparent pixels, and of some images the file
# ends before the last pixel.
_CUT_SHORT = "image_id % 25 = 3"
_RASTERS_SQL = sql(
    "pixels",
    f""", dense as (select image_id, idx, r, g, b, a from pixels union all select image_id, unnest(range(n_total, w * h)), 0, 0, 0, 0 from images)
 select cast(image_id as varchar) as image, idx, cast(idx % {d.WIDTH} as int) as x, cast(idx // {d.WIDTH} as int) as y, case when a > 0 then r else 0 end as r, case when a > 0 then g else 0 end as g,
  case when a > 0 then b else 0 end as b, a, null as error from dense where not {_CUT_SHORT}
 union all select cast(image_id as varchar), null, null, null, null, null, null, null, 'truncated' from images where {_CUT_SHORT}""",
)


def _written(spark, sf):
    """Folder and list of the raster files of all images."""
    sizes = d.images(spark, sf)
    clear = [F.lit(0).alias(c) for c in "rgba"]
    filled = sizes.filter("n_total < w * h").select("image_id", F.explode(F.expr("sequence(n_total, cast(w * h - 1 as bigint))")).alias("idx"), *clear)
    dense = d.pixels(spark, sf).select("image_id", "idx", *"rgba").unionByName(filled).join(sizes.drop("n_total"), "image_id")
    folder = f"{ensure_checkpoint_dir(spark)}/rasters-{uuid.uuid4().hex}"
    return folder, cut(rs.write_rasters(dense.filter(f"not ({_CUT_SHORT} and idx = w * h - 1)"), folder))


def _pixels_and_errors(bands):
    image = F.regexp_extract("image_id", "([^/]+)[.]bmp$", 1).alias("image")
    bands = cut(bands)  # read once for both
    found = im.band_pixels(bands).select(image, "idx", "x", "y", "r", "g", "b", "a", F.lit(None).cast("string").alias("error"))
    return found.unionByName(bands.filter("error is not null").select(image, "error"), allowMissingColumns=True)


@query("a1_raster_scan", _RASTERS_SQL)
def raster_scan(spark, sf):
    """Every pixel of the raster files of all images, read by byte ranges; files that cannot be read keep a row."""
    folder, _ = _written(spark, sf)
    return _pixels_and_errors(rs.read_rasters(spark, folder))


@query("a2_inline_rasters", _RASTERS_SQL)
def inline_rasters(spark, sf):
    """The same files as ``data:`` texts: payloads of inline images, cut into bands and expanded to pixels."""
    folder, done = _written(spark, sf)
    uri = F.concat(F.lit("data:image/bmp;base64,"), F.base64("content"))
    inline = im.inline_images(read_files(done, folder).select(F.col("name").alias("image_id"), uri.alias("uri")))
    return _pixels_and_errors(rs.payload_bands(inline, "image_id", "content"))


_URI = """case doc_id % 5 when 0 then concat('data:text/plain;base64,', {b64}) when 1 then concat('data:text/plain,', text)
 when 2 then 'data:text/plain;base64' when 3 then 'data:text/plain;base64,%%%' else concat('data:;base64,', {b64}) end"""


@query(
    "a2_inline_images",
    """select doc_id, case when doc_id % 5 in (0,4) then text end as content,
 case when doc_id % 5 = 1 then case when split_part(text, ',', 1) like '%base64%' then 'x' else 'payload is not base64' end when doc_id % 5 = 2 then 'no comma before the payload'
  when doc_id % 5 = 3 then 'payload cannot be decoded' end as error from documents""",
)
def inline_images(spark, sf):
    rows = d.table(spark, sf, "documents").select("doc_id", F.expr(_URI.format(b64="base64(cast(text as binary))")).alias("uri"))
    out = im.inline_images(rows)
    return out.select("doc_id", F.decode("content", "UTF-8").alias("content"), "error")


_LINE = """case p_partkey % 6 when 0 then '  ' when 1 then concat('// ', p_name) when 2 then '#' when 3 then concat('# ', p_name) when 4 then concat('  #', substring('0123456789', cast(p_partkey % 8 as int) + 1, 3), ' ') else p_name end"""


@query(
    "a5_colour_lines",
    f"select id, trim(line) as raw from (select p_partkey as id, {_LINE} as line from part) where p_or(line) ".replace("p_or(line)", "trim(line) <> '' and trim(line) not like '//%' and not (trim(line) = '#' or trim(line) like '# %')"),
)
def colour_lines(spark, sf):
    lines = d.table(spark, sf, "part").selectExpr("p_partkey as id", f"{_LINE} as raw")
    return lists.clean_lines(lines, "raw")


@query(
    "a6_catalogue_scan",
    sql(
        "catalogue",
        """select pos as doc, id, name, description, array_to_string(categories, '|') as categories, array_to_string(tags, '|') as tags, array_to_string(colors, '|') as colors, null as error
 from catalogue where pos % 7 not in (1, 2, 3, 4) union all select pos, null, null, null, null, null, null,
 case pos % 7 when 1 then 'unsupported schema' when 2 then 'unknown field' when 3 then 'unknown field' else 'malformed' end from catalogue where pos % 7 in (1, 2, 3, 4)""",
    ),
)
def catalogue_scan(spark, sf):
    c = d.catalogue(spark, sf)
    body = ["id", "name", "description", "categories", "tags", "colors"]
    plain, extra = F.struct(*body), F.struct(*body, F.lit("x").alias("mood"))
    kind = F.col("pos") % 7
    schema = F.when(kind == 1, "other/v9").otherwise(sinks.SCHEMA_NAME)
    doc = F.to_json(F.struct(schema.alias("schema"), F.array(plain).alias("palettes")))
    odd = F.to_json(F.struct(schema.alias("schema"), F.array(extra).alias("palettes")))
    top = F.to_json(F.struct(schema.alias("schema"), F.lit(1).alias("version"), F.array(plain).alias("palettes")))
    text = F.when(kind == 2, odd).when(kind == 3, top).when(kind == 4, F.lit("{not json")).otherwise(doc)
    rows, bad = src.parse_catalogues(c.select(F.col("pos").alias("doc"), text.alias("text")))
    lists_ = [F.array_join(x, "|").alias(x) for x in ("categories", "tags", "colors")]
    good = rows.select("doc", "id", "name", "description", *lists_, F.lit(None).cast("string").alias("error"))
    blanks = [F.lit(None).cast("string").alias(x) for x in body]
    return good.unionByName(bad.select("doc", *blanks, "error"))


# --- publishing ----------------------------------------------------------------------------------------------


def _cap(v: str, top: int, scale: int) -> str:
    return f"cast(floor(least(greatest(({v})*{scale}, 0e0), {top}e0)+0.5) as int)"


def _envelope_sql() -> str:
    def arr(*xs):
        return "'[' || " + " || ',' || ".join(xs) + " || ']'"

    hsl = arr(_cap("hsl_h", 360, 1), _cap("hsl_s", 100, 100), _cap("hsl_l", 100, 100))
    hsv = arr(_cap("hsv_h", 360, 1), _cap("hsv_s", 100, 100), _cap("hsv_v", 100, 100))
    okc = arr(_cap("ok_l", 100, 100), _cap("ok_c", 100, 100), _cap("ok_h", 360, 1))
    rgba = f"case when a <> 255 then ',\"rgba\":' || {arr('r', 'g', 'b', 'a')} else '' end"
    item = f"""'{{"hex":"' || {_TEXT_SQL['hex']} || '","rgb":' || {arr('r', 'g', 'b')} || {rgba} || ',"hsl":' || {hsl} || ',"hsv":' || {hsv} || ',"oklch":' || {okc} || '}}'"""
    return f"""select palette_id, '{{"schema":"{sinks.SCHEMA_NAME}","tool":"palette","params":{{"prefix":"color"}},"result":{{"palette":{{"size":' || count(*) || ',"colors":[' || string_agg({item}, ',' order by ord) || ']}}}}}}' as document
 from {_spaces_sql()} group by palette_id"""


@query("a7_envelopes", sql("palettes", _envelope_sql()))
def envelopes(spark, sf):
    return sinks.envelopes(d.palettes(spark, sf), "palette", {"prefix": "color"})


def _tokens_sql(value: str, src_: str) -> str:
    nl = "chr(10)"
    n = "(ord+1)"
    lines = {
        "css": f"'  --color-' || {n} || ': ' || v || ';' || {nl}",
        "scss": f"'$color-' || {n} || ': ' || v || ';' || {nl}",
        "less": f"'@color-' || {n} || ': ' || v || ';' || {nl}",
        "plain": f"v || {nl}",
        "gpl": f"printf('%3d %3d %3d', r, g, b) || chr(9) || 'color-' || {n} || {nl}",
        "tailwind": f"'  \"color-' || {n} || '\": \"' || v || '\",' || {nl}",
    }
    agg = {f: f"string_agg({t}, '' order by ord)" for f, t in lines.items()}
    whole = {
        "css": f"':root {{' || {nl} || {agg['css']} || '}}' || {nl}",
        "scss": f"{agg['scss']} || {nl} || '$color-list: (' || string_agg('$color-' || {n}, ', ' order by ord) || ');' || {nl}",
        "less": f"{agg['less']} || {nl} || '@color-list: ' || string_agg('@color-' || {n}, ', ' order by ord) || ';' || {nl}",
        "plain": agg["plain"],
        "gpl": f"'GIMP Palette' || {nl} || 'Name: color' || {nl} || 'Columns: 0' || {nl} || '#' || {nl} || {agg['gpl']}",
        "tailwind": f"'module.exports = {{' || {nl} || {agg['tailwind']} || '}};' || {nl}",
    }
    q = f"(select *, {value} as v from {src_})"
    return " union all ".join(f"select palette_id, '{f}' as format, {t} as text from {q} group by palette_id" for f, t in whole.items())


@query("a8_design_tokens", sql("palettes", _tokens_sql(_TEXT_SQL["hex"], "palettes")))
def design_tokens(spark, sf):
    return sinks.design_tokens(d.palettes(spark, sf))


@query("a8_design_tokens_hsl", sql("palettes", _tokens_sql(_TEXT_SQL["hsl"], _spaces_sql())))
def design_tokens_hsl(spark, sf):
    return sinks.design_tokens(d.palettes(spark, sf), notation="hsl")


@query("a8_token_lines", sql("palettes", f"select palette_id, ord as pos, '  --color-' || (ord+1) || ': ' || {_TEXT_SQL['hex']} || ';' as line from palettes"))
def token_lines(spark, sf):
    return sinks.token_lines(d.palettes(spark, sf))


@query(
    "a9_gradient_segments",
    sql(
        "palettes",
        f"""select palette_id, ord, {o.micro('ord/segs')} as "left", {o.micro('(ord/segs+(ord+1)/segs)/2')} as mid, {o.micro('(ord+1)/segs')} as "right", r, g, b, coalesce(r1, r) as r1, coalesce(g1, g) as g1, coalesce(b1, b) as b1 from
 (select *, greatest(n-1, 1)::double as segs from (select *, lead(r) over w as r1, lead(g) over w as g1, lead(b) over w as b1, count(*) over (partition by palette_id) as n from palettes window w as (partition by palette_id order by ord)))
 where r1 is not null or n = 1""",
    ),
)
def gradient_segments(spark, sf):
    s = sinks.gradient_segments(d.palettes(spark, sf))
    return s.select("palette_id", "ord", *[micro(c).alias(c) for c in ("left", "mid", "right")], "r", "g", "b", "r1", "g1", "b1")


_CSS_SQL = sql("stops", "select ramp_id, 'linear-gradient(in oklch 90deg, ' || string_agg(printf('#%02x%02x%02x %.1f%%', r, g, b, floor(pos*1000+0.5)/10), ', ' order by ord) || ')' as css from stops group by ramp_id")


@query(
    "a9_css_gradients",
    _CSS_SQL,
)
def css_gradients(spark, sf):
    return sinks.css_gradients(d.stops(spark, sf), "oklch")


# --- published files ------------------------------------------------------------------------------------------


def _published(spark, pieces, name, key="palette_id", ordered=False):
    """Documents as files of the checkpoint folder, read back as (key, kind, text)."""
    folder = f"{ensure_checkpoint_dir(spark)}/published-{uuid.uuid4().hex}"
    done = cut(pb.publish(pieces, folder, name, ordered))
    parts = F.split("name", "[.]")
    return read_files(done, folder).select(parts[0].cast("bigint").alias(key), parts[1].alias("kind"), F.col("content").cast("string").alias("text"))


@query("a7_published_envelopes", sql("palettes", _envelope_sql()))
def published_envelopes(spark, sf):
    pieces = pb.envelope_pieces(d.palettes(spark, sf), "palette", {"prefix": "color"})
    return _published(spark, pieces, F.concat("palette_id", F.lit(".json"))).select("palette_id", F.col("text").alias("document"))


@query("a8_published_tokens", sql("palettes", _tokens_sql(_TEXT_SQL["hex"], "palettes")))
def published_tokens(spark, sf):
    pieces = pb.token_pieces(d.palettes(spark, sf))
    return _published(spark, pieces, F.concat_ws(".", F.col("palette_id").cast("string"), "format")).select("palette_id", F.col("kind").alias("format"), "text")


@query("a9_published_css", _CSS_SQL)
def published_css(spark, sf):
    pieces = pb.css_pieces(d.stops(spark, sf), "oklch")
    return _published(spark, pieces, F.concat("ramp_id", F.lit(".css")), "ramp_id").select("ramp_id", F.col("text").alias("css"))


@query(
    "a10_published_lattices",
    sql(
        "palettes",
        """select palette_id, 'LUT_3D_SIZE 17' || chr(10) || string_agg(printf('%.6f %.6f %.6f', r/255e0, g/255e0, b/255e0) || chr(10), '' order by node) as text from
 (select palette_id, b*289 + g*17 + r as node, cast(floor(r*255/16e0+0.5) as int) as r, cast(floor(g*255/16e0+0.5) as int) as g, cast(floor(b*255/16e0+0.5) as int) as b from (select distinct palette_id from palettes), range(17) t(r), range(17) u(g), range(17) v(b)) group by palette_id""",
    ),
)
def published_lattices(spark, sf):
    """An identity lattice for every palette, one text file each."""
    ids = spread_by(d.palettes(spark, sf).select("palette_id").distinct(), "palette_id")
    return _published(spark, pb.identity_pieces(ids, 17), F.concat("palette_id", F.lit(".cube")), ordered=True).select("palette_id", "text")


# --- catalogue -------------------------------------------------------------------------------------------------

_SLUG = "lower(regexp_replace(regexp_replace({0}, '[^\\p{{L}}\\p{{Nd}}]+', '-', 'g'), '^-+|-+$', '', 'g'))"
_COLS = """cl as (select pos, id, name, unnest(colors) as raw, cast(generate_subscripts(colors, 1) - 1 as int) as ord from catalogue),
 hx as (select *, case when regexp_full_match(lower(trim(raw)), '#[0-9a-f]{6}') then lower(trim(raw)) when trim(raw) = 'tomato' then '#ff6347' end as hex from cl)"""
_CATS = f"ct as (select pos, trim(nm) as nm, cpos, {_SLUG.format('trim(nm)')} as slug from (select pos, unnest(categories) as nm, generate_subscripts(categories, 1) as cpos from catalogue))"


@query(
    "h1_violations",
    sql(
        "catalogue",
        f""", {_COLS}, {_CATS}
 select pos, 'bad id' as rule, id as value from catalogue where not regexp_full_match(id, '[a-z0-9]+(-[a-z0-9]+)*')
 union all select pos, 'no name', null from catalogue where trim(name) = ''
 union all select pos, 'no categories', null from catalogue where len(categories) = 0
 union all select distinct pos, 'empty category', null from ct where nm = ''
 union all select distinct pos, 'category without slug', null from ct where nm <> '' and slug = ''
 union all select pos, 'no colors', null from catalogue where len(colors) = 0
 union all select pos, 'duplicate id', id from (select *, row_number() over (partition by id order by pos) as k from catalogue) where k > 1
 union all select pos, case when trim(raw) = '' then 'empty color' else 'bad color' end, trim(raw) from hx where hex is null
 union all select pos, 'duplicate color', trim(raw) from (select *, row_number() over (partition by pos, hex order by ord) as k from hx where hex is not null) where k > 1""",
    ),
)
def catalogue_violations(spark, sf):
    return cg.violations(d.catalogue(spark, sf))


@query("h2_category_slugs", sql("catalogue", f", {_CATS} select pos, slug, arg_min(nm, cpos) as name from ct where slug <> '' group by pos, slug"))
def category_slugs(spark, sf):
    return cg.category_rows(d.catalogue(spark, sf)).select("pos", "slug", "name")


@query(
    "h3_categories",
    sql("catalogue", f", {_CATS} select slug, arg_min(nm, pos*1000 + cpos) as name, count(distinct pos) as count from ct where slug <> '' group by slug"),
)
def category_listing(spark, sf):
    return cg.categories(d.catalogue(spark, sf)).orderBy(F.lower("name"))


def _list_sql(slug: str, tag: str) -> str:
    return sql("catalogue", f", {_CATS} select pos, id from catalogue where pos in (select pos from ct where slug = '{slug}') and len(list_filter(tags, lambda t: lower(t) like '%{tag}%')) > 0")


@query("h4_list_palettes", _list_sql("middle-east", "n1"))
def list_palettes(spark, sf):
    return cg.list_palettes(d.catalogue(spark, sf), "Middle East", " N1 ").select("pos", "id")


@query(
    "h5_palette_by_id",
    sql("catalogue", ", w as (select distinct case when s_suppkey % 3 = 0 then printf('PAL-%d', s_suppkey) else printf('pal-%d', s_suppkey) end as id from supplier) select w.id, pos from w left join catalogue c on w.id = c.id"),
)
def palette_by_id(spark, sf):
    wanted = d.table(spark, sf, "supplier").select(F.format_string("%s-%d", F.when(F.col("s_suppkey") % 3 == 0, "PAL").otherwise("pal"), "s_suppkey").alias("id")).distinct()
    return cg.palettes_by_id(d.catalogue(spark, sf), wanted).select("id", "pos")


def _append_sql() -> str:
    """Free numbers listed per base slug and matched to the rows by rank (no two bases share an id here)."""
    name = "trim(case when p_partkey % 50 = 0 then ' ' when p_partkey % 9 = 0 then 'Pal ' || (p_partkey % 70) else p_name end)"
    return sql(
        "catalogue",
        f""", old as (select pos, id from catalogue where regexp_full_match(id, '[a-z0-9]+(-[a-z0-9]+)*')),
 fresh as (select p_partkey as seq, {name} as name, p_partkey % 41 = 0 as bad, printf('#ff0000|#00ff00|#0000%02x', p_partkey % 256) as colors from part),
 good as (select *, replace(lower(name), ' ', '-') as base, row_number() over (partition by lower(name) order by seq) as k from fresh where name <> '' and not bad),
 cand as (select base, q.n, case when q.n = 1 then base else base || '-' || q.n end as id from (select base, count(*) as m from good group by base) cross join (select unnest(range(1, (select count(*) from part) + 200)) as n) q where q.n <= m + 100),
 free as (select *, row_number() over (partition by base order by n) as k from cand where id not in (select id from old))
 select seq + (select max(pos) from old) + 1 as pos, free.id, name, 'new' as description, 'Saved|Warm' as categories, 'a' as tags, colors, null as error from good join free on good.base = free.base and good.k = free.k
 union all select seq, null, null, null, null, null, null, case when name = '' then 'no palette name' else 'unreadable color' end from fresh where name = '' or bad""",
    )


@query("h6_append", _append_sql())
def append(spark, sf):
    fresh = d.table(spark, sf, "part").selectExpr(
        "p_partkey as seq",
        "case when p_partkey % 50 = 0 then ' ' when p_partkey % 9 = 0 then concat('Pal ', p_partkey % 70) else p_name end as name",
        "' new ' as description",
        "array(' saved', 'Warm ', '') as categories",
        "array(' a ', '') as tags",
        "case when p_partkey % 41 = 0 then array('#12345') else array('RED', '#0f0', format_string('#0000%02x', p_partkey % 256)) end as colors",
    )
    base = d.catalogue(spark, sf).filter(F.col("id").rlike(cg.ID_RULE))
    grown, refused = cg.append(base, fresh)
    lists_ = [F.array_join(x, "|").alias(x) for x in ("categories", "tags", "colors")]
    saved = grown.filter(F.array_contains("categories", cg.SAVED)).select("pos", "id", "name", "description", *lists_, F.lit(None).cast("string").alias("error"))
    blanks = [F.lit(None).cast("string").alias(x) for x in ("id", "name", "description", "categories", "tags", "colors")]
    return saved.unionByName(refused.select(F.col("seq").alias("pos"), *blanks, "error"))


@query("h7_merge", sql("catalogue", "select pos, id, 'base' as origin from catalogue union all select pos, id || '-copy', 'added' from catalogue where pos % 4 = 0"))
def merge(spark, sf):
    base = cg.load_or_default(spark, f"{sf}/no-such-catalogue.json", d.catalogue(spark, sf)).select("pos", "id", F.lit("base").alias("origin"))
    added = base.filter("pos % 4 = 0").select("pos", F.concat("id", F.lit("-copy")).alias("id"), F.lit("added").alias("origin"))
    return base.unionByName(added)


@query(
    "h8_palette_slots",
    sql("catalogue", f", {_COLS} select pos, ord, case when hex is not null then ('0x' || hex[2:3])::int end as r, case when hex is not null then ('0x' || hex[4:5])::int end as g, case when hex is not null then ('0x' || hex[6:7])::int end as b, 'library:' || id as source from hx"),
)
def palette_slots(spark, sf):
    c = d.catalogue(spark, sf)
    rows = cg.color_rows(c).withColumn("source", F.concat(F.lit("library:"), F.col("id")))
    return rows.select("pos", "ord", "r", "g", "b", "source")


@query("h9_tags", sql("catalogue", "select distinct unnest(tags) as tag from catalogue"))
def tags(spark, sf):
    return cg.tag_vocabulary(d.catalogue(spark, sf)).orderBy("tag")


_SEARCH_SQL = sql("catalogue", "select pos, id from catalogue where list_contains(categories, 'ASIA') and list_contains(tags, 'n2') and lower(name || ' ' || description) like '%nation_1%'")


@query("h9_search", _SEARCH_SQL)
def search(spark, sf):
    return cg.search(d.catalogue(spark, sf), "ASIA", "n2", " Nation_1").select("pos", "id")


def _indexed(spark, sf):
    folder = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    po.write_index(d.catalogue(spark, sf), folder)
    return folder


@query("h4_indexed_palettes", _list_sql("tone-1", "east"))
def indexed_palettes(spark, sf):
    return po.list_palettes(spark, _indexed(spark, sf), "Tone & 1", " EAST").select("pos", "id")


@query("h9_indexed_search", _SEARCH_SQL)
def indexed_search(spark, sf):
    return po.search(spark, _indexed(spark, sf), "ASIA", "n2", " Nation_1").select("pos", "id")
