"""Queries over pixels, colour strings and palettes: projections, filters, ordering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import kernel
from ..operators import enrich, pixels as px, strips as st
from . import derived as d
from . import oracle as o
from .derived import sql
from .registry import query


def micro(c):
    col = F.col(c) if isinstance(c, str) else c
    return F.floor(col * 1e6 + 0.5).cast("bigint")


@query("a3_pixel_ingest", sql("pixels", "select image_id, idx, x, y, r, g, b, a from pixels"))
def pixel_ingest(spark, sf):
    return d.pixels(spark, sf)


# --- strings ----------------------------------------------------------------------------------------------

_HEXFIX = """hexes as (select id, raw, low, case when length(dg) in (3,4) then regexp_replace(dg, '(.)', '\\1\\1', 'g') else dg end as dg2 from
 (select *, regexp_replace(regexp_replace(low,'^#',''),'^0x','') as dg from (select id, raw, lower(trim(raw)) as low from color_strings)))"""
_NAMED_SQL = "named(name, hx) as (values " + ",".join(f"('{n}','{c}')" for n, c in K.NAMED) + ")"


def _parse_sql() -> str:
    """Each notation parsed with its own regular expression over whole strings."""
    n = r"\s*([+-]?[0-9.]+)"
    sep = r"[\s,/]+"

    def grab(i):
        return f"cast(nullif(regexp_extract(body, '^\\s*([+-]?[0-9.]+)[a-z%]*\\s*[,\\s]\\s*([+-]?[0-9.]+)[a-z%]*(\\s*[,\\s]\\s*([+-]?[0-9.]+)[a-z%]*)?', {i}), '') as double)"

    base = f"""fns as (select id, lower(trim(split_part(raw,'(',1))) as fn, regexp_extract(raw, '\\((.*)\\)', 1) as body from color_strings where raw like '%(%'),
 args as (select id, case when fn in ('rgba','hsla','hsva') then fn[1:3] else fn end as fn, body, {grab(1)} as p, {grab(2)} as q, {grab(4)} as s,
   case when body like '%/%50\\%%' escape '\\' then 128 else 255 end as a from fns),
 unit as (select *, q/100 as uq, s/100 as us, case when body like '%\\%%' escape '\\' or p > 1 then p/100 else p end as up from args where s is not null)"""
    rgb = "select id, cast(p as int) as r, cast(q as int) as g, cast(s as int) as b, a from unit where fn='rgb'"
    hsl = f"select id, {o.from_hsl('p', 'uq', 'us')}, a from unit where fn='hsl'"
    hls = f"select id, {o.from_hsl('(p*360e0)', 'us', 'uq')}, a from unit where fn='hls'"
    hsv = f"select id, {o.from_hsv('p', 'uq', 'us')}, a from unit where fn='hsv'"
    lab = "select id, r, g, b, a from " + o.lab_bytes("(select id, a, up*100 as nl, q as na, s as nb from unit where fn='lab')")
    lch = "select id, r, g, b, a from " + o.lab_bytes("(select id, a, up*100 as nl, q*cos(radians(s)) as na, q*sin(radians(s)) as nb from unit where fn='lch')")
    okl = "select id, r, g, b, a from " + o.oklab_bytes("(select id, a, up as nl, q as na, s as nb from unit where fn='oklab')")
    okc = "select id, r, g, b, a from " + o.oklab_bytes("(select id, a, up as nl, q*cos(radians(s)) as na, q*sin(radians(s)) as nb from unit where fn='oklch')")
    h = [f"('0x'||dg2[{i}:{i + 1}])::int" for i in (1, 3, 5)]
    hexq = f"select id, {h[0]} as r, {h[1]} as g, {h[2]} as b, case when length(dg2)=8 then ('0x'||dg2[7:8])::int else 255 end as a from hexes where regexp_full_match(dg2,'[0-9a-f]{{6}}|[0-9a-f]{{8}}') and low not like '%(%'"
    nh = [f"('0x'||hx[{i}:{i + 1}])::int" for i in (1, 3, 5)]
    namedq = f"select id, {nh[0]} as r, {nh[1]} as g, {nh[2]} as b, 255 as a from hexes join named on regexp_replace(low,'[-_ ]','','g') = name"
    union = " union all ".join([rgb, hsl, hls, hsv, lab, lch, okl, okc, hexq, namedq])
    return sql("color_strings", "," + _HEXFIX + ",\n" + _NAMED_SQL + ",\n" + base + ",\nparsed as (" + union + ")\n")


_PARSE = _parse_sql()


@query("b1_standardise_strings", _PARSE + "select id, r, g, b, a from parsed")
def standardise_strings(spark, sf):
    good, _ = enrich.split_bad(enrich.standardise(d.color_strings(spark, sf)))
    return good.select("id", "r", "g", "b", "a")


@query(
    "b2_named_lookup",
    sql("color_strings", ",\n" + _NAMED_SQL + "\nselect id, name, '#' || hx as hex from color_strings join named on regexp_replace(lower(trim(raw)),'[-_ ]','','g') = name"),
)
def named_lookup(spark, sf):
    hit = enrich.name_lookup(d.color_strings(spark, sf), "raw")
    return hit.select("id", "name", kernel.hex_text(F.col("r"), F.col("g"), F.col("b")).alias("hex"))


@query(
    "b3_bad_colours",
    _PARSE + "select id, trim(raw) as value from color_strings where id not in (select id from parsed)",
)
def bad_colours(spark, sf):
    _, bad = enrich.split_bad(enrich.standardise(d.color_strings(spark, sf)))
    return bad.select("id", F.trim("raw").alias("value"))


@query(
    "b3_notation_profile",
    _PARSE
    + """select notation, count(*) as n, count(*) filter (where id not in (select id from parsed)) as n_bad from (
 select c.id, case when raw like '%(%' then case when lower(split_part(raw,'(',1)) in ('rgba') then 'rgb' else lower(split_part(raw,'(',1)) end
  when trim(raw) like '#%' then 'hex' when name is not null then 'named' when regexp_full_match(trim(raw),'[0-9a-fA-F]{6}') then 'hex' else 'unknown' end as notation
 from color_strings c left join named on regexp_replace(lower(trim(raw)),'[-_ ]','','g') = name) group by notation""",
)
def notation_profile(spark, sf):
    return enrich.notation_profile(enrich.standardise(d.color_strings(spark, sf)))


# --- pixels -------------------------------------------------------------------------------------------------


@query(
    "b4_positional_sample",
    sql(
        "pixels",
        """select image_id, idx, pos from (select *, row_number() over (partition by image_id order by idx) - 1 as pos, count(*) over (partition by image_id) as n from pixels where a >= 1)
 where n <= 100 or (pos % (n // 100) = 0 and pos // (n // 100) < 100)""",
    ),
)
def positional_sample(spark, sf):
    return px.subsample(px.opaque(d.pixels(spark, sf)), cap=100).select("image_id", "idx", "pos")


@query(
    "b5_alpha_mask_stats",
    sql("pixels", "select image_id, count(*) as n_total, count(*) filter (where a >= 1) as n_valid, case when count(*) filter (where a >= 1) = 0 then 'no pixels left after alpha mask' end as error from pixels group by image_id"),
)
def alpha_mask_stats(spark, sf):
    return px.pixel_stats(d.colours(spark, sf))


@query(
    "b6_downsample",
    sql(
        "pixels",
        """select image_id, cast(cy * nw + cx as bigint) as idx, cx as x, cy as y, cast(sum(r) // count(*) as int) as r, cast(sum(g) // count(*) as int) as g, cast(sum(b) // count(*) as int) as b, cast(sum(a) // count(*) as int) as a from (
 select *, x * nw // w as cx, y * nh // h as cy from (select *, case when greatest(w,h) <= 8 then w when w >= h then 8 else greatest(w*8//h,1) end as nw,
  case when greatest(w,h) <= 8 then h when w >= h then greatest(h*8//w,1) else 8 end as nh from pixels join images using (image_id)))
 group by image_id, nw, cx, cy""",
    ),
)
def downsample(spark, sf):
    return px.downsample(d.pixels(spark, sf), d.images(spark, sf), side=8)


_SPACES = [
    "hsl_h", "hsl_s", "hsl_l", "hsv_h", "hsv_s", "hsv_v", "lab_l", "lab_a", "lab_b", "lch_c", "lch_h",
    "ok_l", "ok_a", "ok_b", "ok_c", "ok_h",
]


def _steady(c: str) -> str:
    """Hue of a near-neutral is float noise: report 0."""
    return {"lch_h": "case when lch_c < 0.01 then 0e0 else lch_h end", "ok_h": "case when ok_c < 1e-4 then 0e0 else ok_h end"}.get(c, c)


def _spaces_sql() -> str:
    inner = o.lab(o.oklab("palettes"))
    hsv = f"{o.hue()} as hsl_h, {o.hsl_s()} as hsl_s, {o.hsl_l()} as hsl_l, {o.hue()} as hsv_h, {o.hsv_s()} as hsv_s, {o.hsv_v()} as hsv_v"
    return f"(select *, {hsv}, sqrt(lab_a*lab_a+lab_b*lab_b) as lch_c, {o.wrap('degrees(atan2(lab_b, lab_a))')} as lch_h from {inner})"


@query(
    "b7_colour_spaces",
    sql("palettes", "select palette_id, ord, " + ", ".join(f"{o.micro(_steady(c))} as {c}" for c in _SPACES) + f" from {_spaces_sql()}"),
)
def colour_spaces(spark, sf):
    return enrich.with_spaces(d.palettes(spark, sf)).select("palette_id", "ord", *[micro(F.expr(_steady(c))).alias(c) for c in _SPACES])


def _compact(v: str, n: int) -> str:
    return f"regexp_replace(regexp_replace(printf('%.{n}f', {v}), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


def _ri(v: str) -> str:
    return f"cast(sign({v})*floor(abs({v})+0.5) as int)"


_ALPHA = f"case when a = 0 then '0' when a = 255 then '1' else {_compact('a/255e0', 3)} end"


def _tail(name: str, body: str, alias: str) -> str:
    return f"case when a = 255 then '{name}(' || {body} || ')' else '{alias}(' || {body} || ' / ' || {_ALPHA} || ')' end"


_TEXT_SQL = {
    "hex": "case when a=255 then printf('#%02x%02x%02x', r, g, b) else printf('#%02x%02x%02x%02x', r, g, b, a) end",
    "hex-upper": "case when a=255 then printf('#%02X%02X%02X', r, g, b) else printf('#%02X%02X%02X%02X', r, g, b, a) end",
    "int": "case when a=255 then printf('0x%02X%02X%02X', r, g, b) else printf('0x%02X%02X%02X%02X', r, g, b, a) end",
    "rgb": f"case when a=255 then printf('rgb(%d, %d, %d)', r, g, b) else printf('rgba(%d, %d, %d, ', r, g, b) || {_ALPHA} || ')' end",
    "hsl": _tail("hsl", f"printf('%d %d%% %d%%', {_ri('hsl_h')}, {_ri('hsl_s*100')}, {_ri('hsl_l*100')})", "hsla"),
    "hsv": _tail("hsv", f"printf('%d %d%% %d%%', {_ri('hsv_h')}, {_ri('hsv_s*100')}, {_ri('hsv_v*100')})", "hsva"),
    "hls": _tail("hls", f"{_compact('hsl_h/360e0', 4)} || ' ' || {_compact('hsl_l', 4)} || ' ' || {_compact('hsl_s', 4)}", "hls"),
    "lab": _tail("lab", f"printf('%d %d %d', {_ri('lab_l')}, {_ri('lab_a')}, {_ri('lab_b')})", "lab"),
    "lch": _tail("lch", f"printf('%d %d %d', {_ri('lab_l')}, {_ri('lch_c')}, {_ri('lch_h')})", "lch"),
    "oklab": _tail("oklab", f"{_compact('ok_l', 4)} || ' ' || {_compact('ok_a', 4)} || ' ' || {_compact('ok_b', 4)}", "oklab"),
    "oklch": _tail("oklch", f"{_compact('ok_l', 4)} || ' ' || {_compact('ok_c', 4)} || ' ' || {_compact('ok_h', 1)}", "oklch"),
}


@query(
    "b7_notations",
    sql("palettes", "select palette_id, ord, " + ", ".join(f"{v} as {k.replace('-', '_')}_text" for k, v in _TEXT_SQL.items()) + f" from {_spaces_sql()}"),
)
def notations(spark, sf):
    texts = [enrich.notation_text(n).alias(n.replace("-", "_") + "_text") for n in enrich.NOTATIONS]
    return enrich.with_spaces(d.palettes(spark, sf)).select("palette_id", "ord", *texts)


_METRICS = ["luminance", "lightness", "hue", "saturation", "okl", "ok_chroma"]


@query(
    "b8_perceptual_metrics",
    sql(
        "palettes",
        f"select palette_id, ord, {o.micro(o.lum('r', 'g', 'b'))} as luminance, {o.micro(o.hsl_l())} as lightness, {o.micro(o.hue())} as hue, "
        f"{o.micro(o.hsl_s())} as saturation, {o.micro('ok_l')} as okl, {o.micro('ok_c')} as ok_chroma from {o.oklab('palettes')}",
    ),
)
def perceptual_metrics(spark, sf):
    return enrich.with_metrics(d.palettes(spark, sf)).select("palette_id", "ord", *[micro(c).alias(c) for c in _METRICS])


def _named_dim_sql() -> str:
    rows = ",".join(f"('{n}',{r},{g},{b})" for n, (r, g, b) in enrich._canonical_names())
    return f"dim as (select * from {o.lab(f'(select * from (values {rows}) t(nm, nr, ng, nb))', 'nr', 'ng', 'nb', 'd_')})"


@query(
    "b9_nearest_named",
    sql(
        "palettes",
        ",\n" + _named_dim_sql() + f""", pl as (select * from {o.lab('palettes')}),
 near as (select palette_id, ord, r, g, b, arg_min(nm, (dd, nm)) as name, sqrt(min(dd)) as dist, arg_min(printf('#%02x%02x%02x', nr, ng, nb), (dd, nm)) as nhex from (
  select *, (lab_l-d_l)*(lab_l-d_l)+(lab_a-d_a)*(lab_a-d_a)+(lab_b-d_b)*(lab_b-d_b) as dd from pl cross join dim) group by palette_id, ord, r, g, b)
 select palette_id, ord, name, {o.micro('dist')} as distance, case when dist < 0.5 or nhex = printf('#%02x%02x%02x', r, g, b) then name else name || ' (ΔE=' || {_compact('dist', 2)} || ')' end as label from near""",
    ),
)
def nearest_named(spark, sf):
    out = enrich.nearest_names(d.palettes(spark, sf))
    return out.select("palette_id", "ord", "name", micro("distance").alias("distance"), "label")


def _gamut_sql() -> str:
    """Sixteen halvings as sixteen nested selects."""
    def lins(c):
        L, a, b = "nl", f"({c}*_cos)", f"({c}*_sin)"
        q = [f"pow({L} + {o.num(wa)}*{a} + {o.num(wb)}*{b}, 3)" for wa, wb in K.OKLAB_TO_LMS]
        return " and ".join(f"{o.mix(w, q)} between -1e-4 and 1.0001e0" for w in K.OKLAB_LMS_TO_RGB)

    q = f"(select palette_id, ord, ok_l as nl, ok_c*1.5e0 as c0, ok_h, cos(radians(ok_h)) as _cos, sin(radians(ok_h)) as _sin, 0e0 as lo, ok_c*1.5e0 as hi from {o.oklab('palettes')})"
    for _ in range(16):
        q = f"(select * exclude (lo, hi, fit), case when fit then (lo+hi)/2 else lo end as lo, case when fit then hi else (lo+hi)/2 end as hi from (select *, {lins('((lo+hi)/2)')} as fit from {q}))"
    return f"select palette_id, ord, {lins('c0')} as inside, {o.micro('case when c0 <= 0 then 0e0 when ' + lins('c0') + ' then c0 else lo end')} as clipped from {q}"


@query("b10_gamut_clip", sql("palettes", _gamut_sql()))
def gamut_clip(spark, sf):
    df = kernel.with_oklch(d.palettes(spark, sf)).withColumn("c", F.col("ok_c") * 1.5)
    return kernel.with_clipped_chroma(df, "ok_l", "c", "ok_h", "clip", "inside").select("palette_id", "ord", "inside", micro("clip").alias("clipped"))


@query(
    "b11_artist_wheel",
    sql(
        "palettes",
        f"select palette_id, ord, {o.micro('w')} as ryb, {o.micro(o.ryb_to_rgb('t'))} as turned from (select *, {o.wrap('w + 150e0')} as t from "
        f"(select *, {o.rgb_to_ryb('h')} as w from (select *, {o.hue()} as h from palettes)))",
    ),
)
def artist_wheel(spark, sf):
    h = kernel.hue(*[F.col(c) for c in "rgb"])
    df = d.palettes(spark, sf).withColumn("wheel", kernel.rgb_to_ryb_hue(h))
    return df.select("palette_id", "ord", micro("wheel").alias("ryb"), micro(kernel.ryb_to_rgb_hue(F.col("wheel") + 150.0)).alias("turned"))


@query(
    "b12_back_to_srgb",
    sql(
        "palettes",
        "select palette_id, ord, 'hsl' as via, " + o.from_hsl("(h+40e0)", "s", "l") + f" from (select *, {o.hue()} as h, {o.hsl_s()} as s, {o.hsl_l()} as l from palettes)"
        " union all select palette_id, ord, 'hsv' as via, " + o.from_hsv("(h-75e0)", "s", "v") + f" from (select *, {o.hue()} as h, {o.hsv_s()} as s, {o.hsv_v()} as v from palettes)"
        " union all select palette_id, ord, 'lab' as via, r, g, b from " + o.lab_bytes(f"(select palette_id, ord, lab_l*0.9e0 as nl, lab_a as na, lab_b as nb from {o.lab('palettes')})")
        + " union all select palette_id, ord, 'oklab' as via, r, g, b from " + o.oklab_bytes(f"(select palette_id, ord, ok_l*0.9e0 as nl, ok_a as na, ok_b as nb from {o.oklab('palettes')})")
        + " union all select palette_id, ord, 'oklch' as via, r, g, b from "
        + o.oklab_bytes(f"(select palette_id, ord, ok_l as nl, ok_c*cos(radians(ok_h+30e0)) as na, ok_c*sin(radians(ok_h+30e0)) as nb from {o.oklab('palettes')})"),
    ),
)
def back_to_srgb(spark, sf):
    df = enrich.with_spaces(d.palettes(spark, sf))
    c = F.col
    ways = {
        "hsl": kernel.with_hsl_bytes(df, c("hsl_h") + 40.0, c("hsl_s"), c("hsl_l")),
        "hsv": kernel.with_hsv_bytes(df, c("hsv_h") - 75.0, c("hsv_s"), c("hsv_v")),
        "lab": kernel.with_lab_bytes(df, c("lab_l") * 0.9, c("lab_a"), c("lab_b")),
        "oklab": kernel.with_oklab_bytes(df, c("ok_l") * 0.9, c("ok_a"), c("ok_b")),
        "oklch": kernel.with_oklch_bytes(df, c("ok_l"), c("ok_c"), c("ok_h") + 30.0),
    }
    parts = [v.select("palette_id", "ord", F.lit(k).alias("via"), "r", "g", "b") for k, v in ways.items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    "b13_pixels_at_points",
    sql(
        "pixels",
        """, pts as (select event_id as point_id, image_id, w, h, event_id*37 % 1000 / 1000e0 as nx, event_id*91 % 1000 / 1000e0 as ny
   from events join images on image_id = user_id % (select count(*) from supplier))
 select point_id, p.image_id, p.x, p.y, r, g, b, a from (select *, least(greatest(cast(floor(nx*w) as int),0),w-1) as x, least(greatest(cast(floor(ny*h) as int),0),h-1) as y from pts) p
 left join pixels q on p.image_id = q.image_id and p.x = q.x and p.y = q.y""",
    ),
)
def pixels_at_points(spark, sf):
    n_images = d.table(spark, sf, "supplier").agg(F.count("*")).scalar()
    e = d.table(spark, sf, "events").withColumn("image_id", F.col("user_id") % n_images)
    points = e.selectExpr("event_id as point_id", "image_id", "event_id*37 % 1000 / 1000e0 as nx", "event_id*91 % 1000 / 1000e0 as ny")
    hit = px.pixel_at_points(points, d.pixels(spark, sf), d.images(spark, sf))
    return hit.select("point_id", "image_id", "x", "y", "r", "g", "b", "a")


# --- strips and ordering -----------------------------------------------------------------------------------------


def _strip_sql(width: int, space: str, target: str) -> str:
    hue, light, sat = ("ok_h", "ok_l", "ok_c") if space == "oklch" else (o.hue(), o.hsl_l(), o.hsl_s())
    tr, tg, tb = st.PRIMARIES[target]
    keys = {
        "hue": o.micro(hue),
        "luminance": o.micro(light),
        "saturation": o.micro(sat),
        "distance": f"((r-{tr})*(r-{tr})+(g-{tg})*(g-{tg})+(b-{tb})*(b-{tb}))::bigint",
    }
    longs = " union all ".join(f"select image_id, idx, '{m}' as metric, {k} as key, ok_l, ok_a, ok_b from px" for m, k in keys.items())
    return sql(
        "pixels",
        f""", px as (select * from {o.oklab('(select * from pixels where a >= 1)')}), lg as ({longs}),
 ranked as (select *, row_number() over (partition by image_id, metric order by key, idx) - 1 as i, count(*) over (partition by image_id, metric) as n from lg),
 strip as (select image_id, metric, col, r, g, b from {o.oklab_bytes(f"(select image_id, metric, ((i+1)*{width}-1)//n as col, avg(ok_l) as nl, avg(ok_a) as na, avg(ok_b) as nb from ranked group by image_id, metric, col)")})
""",
    )


@query("d1_strips", _strip_sql(32, "oklch", "blue") + "select * from strip")
def strip_profiles(spark, sf):
    return st.strips(d.pixels(spark, sf), width=32)


@query(
    "d2_strip_fill",
    _strip_sql(1000, "oklch", "red")
    + """select image_id, metric, c.col, coalesce(last_value(r ignore nulls) over w, 0) as r, coalesce(last_value(g ignore nulls) over w, 0) as g, coalesce(last_value(b ignore nulls) over w, 0) as b
 from (select distinct image_id, metric from strip) s cross join range(1000) c(col) left join strip using (image_id, metric, col)
 window w as (partition by image_id, metric order by c.col rows unbounded preceding)""",
)
def strip_fill(spark, sf):
    return st.fill_columns(st.strips(d.pixels(spark, sf), width=1000, target="red"), 1000)


@query("d3_strips_hsl", _strip_sql(32, "hsl", "green") + "select * from strip")
def strips_hsl(spark, sf):
    return st.strips(d.pixels(spark, sf), width=32, space="hsl", target="green")


@query("d4_transparent_excluded", sql("pixels", "select image_id, idx from pixels where a >= 1"))
def transparent_excluded(spark, sf):
    return px.opaque(d.pixels(spark, sf)).select("image_id", "idx")


def _order_sql() -> str:
    keys = {"luminance": o.lum("r", "g", "b"), "lightness": o.hsl_l(), "okl": "ok_l", "hue": o.hue(), "saturation": o.hsl_s(), "frequency": "freq"}
    parts = []
    for by, k in keys.items():
        for rev in (False, True):
            way = "desc" if rev else "asc"
            parts.append(
                f"select palette_id, ord, '{by}' as sorted_by, {str(rev).lower()} as reversed, row_number() over (partition by palette_id order by {k} {way}, ord) - 1 as new_ord from px"
            )
    return sql("palettes", f", px as (select *, ((r*7+g) % 5)/10e0 as freq from {o.oklab('palettes')}) " + " union all ".join(parts))


@query("d5_palette_order", _order_sql())
def palette_order(spark, sf):
    base = d.palettes(spark, sf).withColumn("freq", ((F.col("r") * 7 + F.col("g")) % 5) / 10.0)
    return st.order_by_all(base)


@query(
    "d6_top_k",
    sql("palettes", f"select palette_id, ord, rk from (select palette_id, ord, cast(row_number() over (partition by palette_id order by {o.hsl_s()} desc, ord) - 1 as int) as rk from palettes) where rk < 3"),
)
def top_k(spark, sf):
    key = kernel.hsl_saturation(*[F.col(c) for c in "rgb"])
    return px.top_k(d.palettes(spark, sf), ["palette_id"], [key.desc(), "ord"], 3, rank="rk").select("palette_id", "ord", "rk")
