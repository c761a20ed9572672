"""Queries over pairs, palettes, base colours and gradient stops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import contrast as ct
from ..operators import gradient as gr
from ..operators import harmony as hm
from . import derived as d
from . import oracle as o
from .derived import sql
from .registry import query


def cents(c: str):
    return F.floor(F.col(c) * 100.0 + 0.5).cast("bigint").alias(c)


# --- contrast ---------------------------------------------------------------------------------------------

_LIGHTS = f"""lt as (select *, {o.lum('fr', 'fg', 'fb')} as fl, {o.lum('br', 'bg', 'bb')} as bl, {o.apca_y('fr', 'fg', 'fb')} as ty, {o.apca_y('br', 'bg', 'bb')} as ky from pairs),
 sc as (select *, {o.wcag('fl', 'bl')} as ratio, {o.apca('ty', 'ky')} as rawlc from lt),
 au as (select *, ratio >= 4.5 as aa, ratio >= 3 as aa_large, ratio >= 7 as aaa, ratio >= 4.5 as aaa_large, abs(rawlc) >= 75 as body_text, abs(rawlc) >= 60 as content,
  abs(rawlc) >= 45 as large_heading, abs(rawlc) >= 30 as icon, sign(rawlc)*floor(abs(rawlc)*100+0.5)/100 as lc, floor(abs(rawlc)*100+0.5)/100 as abs_lc from sc)
"""
_W = "cast(floor(ratio*100+0.5) as bigint) as ratio, aa, aa_large, aaa, aaa_large"
_A = "cast(floor(lc*100+0.5) as bigint) as lc, cast(floor(abs_lc*100+0.5) as bigint) as abs_lc, body_text, content, large_heading, icon"



def wcag_cols():
    return [cents("ratio"), "aa", "aa_large", "aaa", "aaa_large"]


def apca_cols():
    return [cents("lc"), cents("abs_lc"), "body_text", "content", "large_heading", "icon"]


@query("e1_wcag_audit", sql("pairs", f", {_LIGHTS} select pair_id, {_W} from au"))
def wcag_audit(spark, sf):
    return ct.audit(d.pairs(spark, sf), "wcag21").select("pair_id", *wcag_cols())


@query("e2_apca_audit", sql("pairs", f", {_LIGHTS} select pair_id, {_A} from au"))
def apca_audit(spark, sf):
    return ct.audit(d.pairs(spark, sf), "apca").select("pair_id", *apca_cols())


@query("e3_both_audits", sql("pairs", f", {_LIGHTS} select pair_id, {_W}, {_A} from au"))
def both_audits(spark, sf):
    return ct.audit(d.pairs(spark, sf), "both").select("pair_id", *wcag_cols(), *apca_cols())


def _pair_text() -> tuple[str, str]:
    spark = "concat(format_string('#%02x%02x%02x: #%02x%02x%02x', fr,fg,fb,br,bg,bb), ', ', format_string('#%02x%02x%02x:#%02x%02x%02x', br,bg,bb,fr,fb,fg), case when pair_id % 7 = 0 then ', nope:#fff' else ', tomato:#12345' end)"
    return spark, spark


@query(
    "e4_pair_list_audit",
    sql(
        "pairs",
        f""", flat as (select pair_id, 0 as pos, fr, fg, fb, br, bg, bb from pairs union all select pair_id, 1, br, bg, bb, fr, fb, fg from pairs),
 sc as (select pair_id, pos, {o.wcag(o.lum('fr', 'fg', 'fb'), o.lum('br', 'bg', 'bb'))} as ratio from flat)
 select pair_id, pos, cast(floor(ratio*100+0.5) as bigint) as ratio, ratio >= 4.5 as aa, ratio >= 3 as aa_large, ratio >= 7 as aaa, ratio >= 4.5 as aaa_large, null as error from sc
 union all select pair_id, 2, null, null, null, null, null, case when pair_id % 7 = 0 then 'cannot parse' else 'invalid hex' end from pairs""",
    ),
)
def pair_list_audit(spark, sf):
    lists = d.pairs(spark, sf).select("pair_id", F.expr(_pair_text()[0]).alias("pairs"))
    return ct.audit_pair_lists(lists).select("pair_id", "pos", *wcag_cols(), "error")


@query(
    "e5_audit_rollup",
    sql(
        "pairs",
        f""", {_LIGHTS} select category, palette_id, count(*) as n_pairs, count(*) filter (where aa) as n_aa, count(*) filter (where aaa) as n_aaa,
 count(*) filter (where aa and aaa) as n_both, count(*) filter (where not aa_large) as n_urgent from au group by rollup(category, palette_id)""",
    ),
)
def audit_rollup(spark, sf):
    return ct.audit_summary(ct.audit_wcag(d.pairs(spark, sf)), "category", "palette_id")


def _suggest_sql(algo: str, tail: str) -> str:
    px = o.oklab("pairs", "fr", "fg", "fb")
    rgb = o.oklab_bytes(f"(select *, lv as nl, ok_c*cos(radians(ok_h)) as na, ok_c*sin(radians(ok_h)) as nb from lad)", out=("sr", "sg", "sb"))
    if algo == "wcag21":
        score, goal = o.wcag("sl", "bl"), "4.5"
        lights = f"{o.lum('sr', 'sg', 'sb')} as sl, {o.lum('br', 'bg', 'bb')} as bl"
    else:
        score, goal = f"(floor(abs({o.apca('sl', 'bl')})*100+0.5)/100)", "60"
        lights = f"{o.apca_y('sr', 'sg', 'sb')} as sl, {o.apca_y('br', 'bg', 'bb')} as bl"
    return sql(
        "pairs",
        f""", lad as (select *, 0.03e0 + (0.99e0-0.03e0)*i/63e0 as lv from {px} cross join (select cast(range as int) as i from range(64)) t),
 cand as (select *, {lights} from {rgb}), smp as (select *, {score} as score, {score} >= {goal} as passes, abs(lv - ok_l) as distance from cand) {tail}""",
    )


@query(
    "e6_fix_samples",
    _suggest_sql("wcag21", "select pair_id, i, sr as r, sg as g, sb as b, cast(floor(score*100+0.5) as bigint) as score, passes from smp"),
)
def fix_samples(spark, sf):
    s = ct.lightness_samples(d.pairs(spark, sf), "pair_id")
    return s.select("pair_id", "i", "r", "g", "b", cents("score"), "passes")


_BEST = """select p.pair_id, n_passing, i, sr as r, sg as g, sb as b, cast(floor(score*100+0.5) as bigint) as score from
 (select pair_id, count(*) filter (where passes) as n_passing from smp group by pair_id) p left join
 (select * from smp where passes qualify row_number() over (partition by pair_id order by distance, i) = 1) q using (pair_id)"""


@query("e6_lightness_fix", _suggest_sql("wcag21", _BEST))
def lightness_fix(spark, sf):
    s = ct.suggest_lightness(d.pairs(spark, sf), "pair_id")
    return s.select("pair_id", "n_passing", "i", "r", "g", "b", cents("score"))


@query("e6_lightness_fix_apca", _suggest_sql("apca", _BEST))
def lightness_fix_apca(spark, sf):
    s = ct.suggest_lightness(d.pairs(spark, sf), "pair_id", "apca")
    return s.select("pair_id", "n_passing", "i", "r", "g", "b", cents("score"))


def _cvd_sql(src: str, keep: str, chans: tuple[str, str, str], kind: str) -> str:
    mixed = ", ".join(
        f"cast(({'+'.join(f'{c}*{w}' for c, w in zip(chans, row))}+500)//1000 as int) as {c}" for c, row in zip(chans, K.CVD_MATRICES[kind])
    )
    return f"select {keep}, '{kind}' as kind, {mixed} from {src}"


@query("e7_vision_simulation", sql("palettes", " union all ".join(_cvd_sql("palettes", "palette_id, ord, a", ("r", "g", "b"), k) for k in K.CVD_KINDS)))
def vision_simulation(spark, sf):
    return ct.simulate_vision(d.palettes(spark, sf)).select("palette_id", "ord", "a", "kind", "r", "g", "b")


def _e8_sql() -> str:
    both = []
    for k in K.CVD_KINDS:
        f = _cvd_sql("pairs", "pair_id, br, bg, bb", ("fr", "fg", "fb"), k)
        both.append(_cvd_sql(f"({f})", "pair_id, fr, fg, fb", ("br", "bg", "bb"), k))
    return sql(
        "pairs",
        f""", sim as ({' union all '.join(both)}), au as (select kind, {o.wcag(o.lum('fr', 'fg', 'fb'), o.lum('br', 'bg', 'bb'))} as ratio from sim)
 select kind, count(*) as n_pairs, count(*) filter (where ratio >= 4.5) as n_aa, count(*) filter (where ratio >= 7) as n_aaa,
  count(*) filter (where ratio >= 7) as n_both, count(*) filter (where ratio < 3) as n_urgent from au group by rollup(kind)""",
    )


@query("e8_simulated_contrast", _e8_sql())
def simulated_contrast(spark, sf):
    p = d.pairs(spark, sf).select("pair_id", *ct.FG, *ct.BG)
    return ct.audit_summary(ct.audit_wcag(ct.simulate_pairs(p)), "kind")


# --- harmonies ---------------------------------------------------------------------------------------------


def _rotated(src: str) -> str:
    """Rows with base channels r, g, b and ``off``: channels turned on the artist wheel."""
    w = f"(select *, {o.rgb_to_ryb('h')} + off as wv from (select *, {o.hue()} as h, {o.hsl_s()} as s, {o.hsl_l()} as l from {src}))"
    t = f"(select *, {o.ryb_to_rgb('wh')} as nh from (select *, {o.wrap('wv')} as wh from {w}))"
    cols = ", ".join(f"case when off = 0 then {c} else {o.hsl_channel('nh', 's', 'l', n)} end as {c}" for c, n in zip("rgb", (0, 8, 4)))
    return f"(select * exclude (r, g, b, wv, wh, nh, h, s, l), {cols} from {t})"


_OFFSETS = ",".join(f"('{t}',{i},{x}e0)" for t, xs in K.HARMONY_OFFSETS.items() for i, x in enumerate(xs))


@query(
    "f1_hue_harmonies",
    sql("bases", f"select base_id, type, ord, r, g, b from {_rotated(f'(select * from bases cross join (values {_OFFSETS}) t(type, ord, off))')}"),
)
def hue_harmonies(spark, sf):
    return hm.hue_harmonies(d.bases(spark, sf)).select("base_id", "type", "ord", "r", "g", "b")


def _expanded_sql(kind: str, count: int) -> str:
    offs = K.HARMONY_OFFSETS[kind]
    n, cycles = len(offs), (count - 1) // len(offs)
    arr = "[" + ",".join(f"{x}e0" for x in offs) + "]"
    src = f"(select *, {o.hsv_s()} as bs, {o.hsv_v()} as bv, {arr}[cast(ord % {n} as int) + 1] as off from bases cross join (select cast(range as int) as ord from range({count})) q)"
    rot = f"(select *, {o.hue()} as ah, 1e0 - ((ord-{n})//{n}+1)/{cycles + 1}e0 as f from {_rotated(src)})"
    echo = {c: o.hsv_channel("ah", "(bs*f)", f"greatest({hm.V_FLOOR}e0, bv*f)", k) for c, k in zip("rgb", (5, 3, 1))}
    cols = ", ".join(f"case when ord < {n} then {c} else {e} end as {c}" for c, e in echo.items())
    return f"select base_id, '{kind}' as type, ord, {cols} from {rot}"


_EXPAND = [("complementary", 8), ("triadic", 7), ("tetradic", 11), ("compound", 4)]


@query("f2_expanded_harmonies", sql("bases", " union all ".join(_expanded_sql(k, c) for k, c in _EXPAND)))
def expanded_harmonies(spark, sf):
    b = d.bases(spark, sf)
    parts = [hm.generate(b, k, c).select("base_id", "type", "ord", "r", "g", "b") for k, c in _EXPAND]
    return reduce(DataFrame.unionByName, parts)


def _analogous_sql(count: int, step: int) -> str:
    src = f"(select *, (ord - {(count - 1) / 2}e0)*{step}e0 as off from bases cross join (select cast(range as int) as ord from range({count})) q)"
    return f"select base_id, {count} as size, ord, r, g, b from {_rotated(src)}"


@query("f3_analogous", sql("bases", f"{_analogous_sql(3, 30)} union all {_analogous_sql(6, 17)}"))
def analogous(spark, sf):
    b = d.bases(spark, sf)
    parts = [hm.generate(b, "analogous", n, s).select("base_id", F.lit(n).alias("size"), "ord", "r", "g", "b") for n, s in ((0, 0), (6, 17))]
    return reduce(DataFrame.unionByName, [p.withColumn("size", F.lit(n)) for p, n in zip(parts, (3, 6))])


def _mono_sql(count: int) -> str:
    step = f"{1 / count!r}e0" if "e" not in repr(1 / count) else repr(1 / count)
    q = f"select *, 0 as ord, s0 as s, -1e0 as dir from (select base_id, r, g, b, {o.hue()} as h, {o.hsv_s()} as s0, {o.hsv_v()} as v0 from bases)"
    walk = f"""walk as ({q} union all select base_id, r, g, b, h, s0, v0, ord + 1,
  case when s+dir*{step} < 0 or s+dir*{step} > 1 then s-dir*{step} else s+dir*{step} end, case when s+dir*{step} < 0 or s+dir*{step} > 1 then -dir else dir end
  from walk where ord < {count - 1})"""
    v = f"greatest({hm.V_FLOOR}e0, least(1e0, case when ord = 1 then v0-{step} else v0 + (case when v0 >= 0.5 then -1e0 else 1e0 end)*{step}*ord end))"
    cols = ", ".join(f"case when ord = 0 then {c} else {o.hsv_channel('h', 's', 'vv', n)} end as {c}" for c, n in zip("rgb", (5, 3, 1)))
    return walk, f"select base_id, ord, {cols} from (select *, {v} as vv from walk)"


def _with_recursive(view: str, walk: str, body: str) -> str:
    return sql(view, f", {walk} {body}").replace("with ", "with recursive ", 1)


@query("f4_monochromatic", _with_recursive("bases", *_mono_sql(7)))
def monochromatic(spark, sf):
    return hm.generate(d.bases(spark, sf), "monochromatic", 7).select("base_id", "ord", "r", "g", "b")


@query(
    "f5_shades",
    sql(
        "bases",
        "select base_id, ord, "
        + ", ".join(f"case when ord = 0 then {c} else {o.hsl_channel('h', 's', 'lp', n)} end as {c}" for c, n in zip("rgb", (0, 8, 4)))
        + f" from (select *, (l*100 - (l*100-5e0)*ord/4e0)/100e0 as lp from (select *, {o.hue()} as h, {o.hsl_s()} as s, {o.hsl_l()} as l from bases cross join (select cast(range as int) as ord from range(5)) q))",
    ),
)
def shades(spark, sf):
    return hm.generate(d.bases(spark, sf), "shades", 5).select("base_id", "ord", "r", "g", "b")


@query(
    "f6_harmony_names",
    """select p_partkey as id, case w when 'small' then 'split-complementary' when 'red' then 'double-complementary' when 'blue' then 'triadic' when 'hot' then 'shades' end as resolved,
 case when w not in ('small','red','blue','hot') then 'unknown harmony type ' || w end as error from (select p_partkey, string_split(p_name, ' ')[1] as w from part)""",
)
def harmony_names(spark, sf):
    w = F.split("p_name", " ")[0]
    asked = F.when(w == "small", " SPLIT").when(w == "red", "double").when(w == "blue", "Triadic").when(w == "hot", "shades").otherwise(w)
    req = d.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), asked.alias("type"))
    return hm.resolve_types(req).select("id", "resolved", "error")


# --- gradients ------------------------------------------------------------------------------------------------


def _ease_sql(t: str, easing: str) -> str:
    return {"linear": t, "ease-in": f"({t}*{t})", "ease-out": f"(1e0-(1e0-{t})*(1e0-{t}))", "ease-in-out": f"({t}*{t}*(3e0-2e0*{t}))"}[easing]


def _blend_sql(src: str, space: str, keep: str) -> str:
    """``src`` has ar..ab, br..bb and t."""
    def mixed(n):
        return f"(x{n} + (y{n}-x{n})*t)"

    def arc(x, y):
        return o.wrap(f"{x} + ({y}-{x} - (case when {y}-{x} > 180 then 360e0 when {y}-{x} < -180 then -360e0 else 0e0 end))*t")

    if space == "rgb":
        cols = ", ".join(f"cast(floor(a{c} + (b{c}-a{c})*t + 0.5e0) as int) as {c}" for c in "rgb")
        return f"select {keep}, {cols} from {src}"
    if space == "hsl":
        q = f"""(select *, {arc('x1', 'y1')} as hh, xs + (ys-xs)*t as ss, xl + (yl-xl)*t as ll from (select *, {o.hue('ar', 'ag', 'ab')} as x1, {o.hsl_s('ar', 'ag', 'ab')} as xs, {o.hsl_l('ar', 'ag', 'ab')} as xl,
          {o.hue('br', 'bg', 'bb')} as y1, {o.hsl_s('br', 'bg', 'bb')} as ys, {o.hsl_l('br', 'bg', 'bb')} as yl from {src}))"""
        return f"select {keep}, {o.from_hsl('hh', 'ss', 'll')} from {q}"
    if space == "lab":
        q = o.lab(o.lab(src, "ar", "ag", "ab", "x"), "br", "bg", "bb", "y")
        return f"select {keep}, r, g, b from " + o.lab_bytes(f"(select *, {mixed('l')} as nl, {mixed('a')} as na, {mixed('b')} as nb from {q})")
    q = o.oklab(o.oklab(src, "ar", "ag", "ab", "x"), "br", "bg", "bb", "y")
    if space == "oklab":
        return f"select {keep}, r, g, b from " + o.oklab_bytes(f"(select *, {mixed('l')} as nl, {mixed('a')} as na, {mixed('b')} as nb from {q})")
    p = f"(select *, {mixed('l')} as nl, {mixed('c')} as nc, {arc('xh', 'yh')} as nh from {q})"
    return f"select {keep}, r, g, b from " + o.oklab_bytes(f"(select *, nc*cos(radians(nh)) as na, nc*sin(radians(nh)) as nb from {p})")


_ENDS = "ends as (select pair_id, fr as ar, fg as ag, fb as ab, br, bg, bb from pairs)"
_EXACT = ", ".join(f"case when ord = 0 then a{c} when ord = {{last}} then b{c} else {c} end as {c}" for c in "rgb")


def _two_stop_sql(space: str, easing: str, steps: int) -> str:
    src = f"(select *, {_ease_sql(f'(ord/{steps - 1}e0)', easing)} as t from ends cross join (select cast(range as int) as ord from range({steps})) q)"
    return f"select pair_id, ord, {_EXACT.format(last=steps - 1)} from ({_blend_sql(src, space, 'pair_id, ord, ar, ag, ab, br, bg, bb')})"


def _ends(spark, sf):
    return d.pairs(spark, sf).select("pair_id", *[F.col(x).alias(y) for x, y in zip(ct.FG, gr.A)], *gr.B)


@query("f7_two_stop_gradient", sql("pairs", f", {_ENDS} " + _two_stop_sql("oklab", "ease-in-out", 9)))
def two_stop_gradient(spark, sf):
    return gr.two_stop(_ends(spark, sf), "pair_id", 9, "oklab", "ease-in-out").select("pair_id", "ord", "r", "g", "b")


def _ramp_sql(steps: int, space: str, easing: str, pos: str = "pos") -> str:
    seg = f"""(select ramp_id, {pos} as p0, lead({pos}) over w as p1, lead({pos}, 2) over w is null as lst, r as ar, g as ag, b as ab, lead(r) over w as br, lead(g) over w as bg, lead(b) over w as bb
 from stops window w as (partition by ramp_id order by ord))"""
    src = f"""(select *, (tt-p0)/(p1-p0) as t from (select *, {_ease_sql(f'(ord/{steps - 1}e0)', easing)} as tt from (select * from {seg} where p1 is not null) cross join (select cast(range as int) as ord from range({steps})) q)
 where case when ord = 0 then p0 = 0 when ord = {steps - 1} then lst else tt >= p0 and (tt < p1 or lst) end)"""
    return f"select ramp_id, ord, {_EXACT.format(last=steps - 1)} from ({_blend_sql(src, space, 'ramp_id, ord, ar, ag, ab, br, bg, bb')})"


@query("f8_positioned_gradient", sql("stops", _ramp_sql(16, "oklab", "linear")))
def positioned_gradient(spark, sf):
    return gr.ramp_table(gr.segments(d.stops(spark, sf), 16), 16).select("ramp_id", "ord", "r", "g", "b")


@query("f8_even_gradient", sql("stops", _ramp_sql(11, "oklab", "ease-in", "(ord/4e0)")))
def even_gradient(spark, sf):
    segs = gr.segments(gr.even_positions(d.stops(spark, sf)), 11)
    return gr.ramp_table(segs, 11, "oklab", "ease-in").select("ramp_id", "ord", "r", "g", "b")


@query(
    "f8_invalid_ramps",
    """with st as (select p_partkey // 6 as ramp_id, p_partkey % 6 as ord, case (p_partkey // 6) % 4 when 0 then (p_partkey%6)/5e0 when 1 then (p_partkey%6)/6e0
  when 2 then least((p_partkey%6)/4e0, 1e0) else (p_partkey%6)/5e0 end as pos from part),
 g as (select *, pos - lag(pos) over (partition by ramp_id order by ord) as gap from st),
 a as (select ramp_id, count(*) as n, min(gap) as gap, arg_min(pos, ord) as f, arg_max(pos, ord) as l from g group by ramp_id)
 select ramp_id, error from (select ramp_id, case when n < 2 then 'fewer than two stops' when n > 32 then 'more stops than steps' when f <> 0 or l <> 1 then 'positions do not run from 0 to 1'
  when gap <= 0 then 'positions do not grow' end as error from a) where error is not null""",
)
def invalid_ramps(spark, sf):
    st = d.table(spark, sf, "part").selectExpr(
        "p_partkey div 6 as ramp_id", "p_partkey % 6 as ord",
        "case (p_partkey div 6) % 4 when 0 then (p_partkey%6)/5e0 when 1 then (p_partkey%6)/6e0 when 2 then least((p_partkey%6)/4e0, 1e0) else (p_partkey%6)/5e0 end as pos",
    )
    return gr.invalid_ramps(st, 32)


@query("f9_gradient_spaces", sql("stops", " union all ".join(f"select '{s}' as space, * from ({_ramp_sql(9, s, 'linear')})" for s in gr.SPACES)))
def gradient_spaces(spark, sf):
    segs = gr.segments(d.stops(spark, sf), 9)
    return gr.in_all(lambda s: gr.ramp_table(segs, 9, s), gr.SPACES, "space").select("space", "ramp_id", "ord", "r", "g", "b")


@query("f10_easing", sql("stops", " union all ".join(f"select '{e}' as easing, * from ({_ramp_sql(9, 'rgb', e)})" for e in gr.EASINGS)))
def easing(spark, sf):
    segs = gr.segments(d.stops(spark, sf), 9)
    return gr.in_all(lambda e: gr.ramp_table(segs, 9, "rgb", e), gr.EASINGS, "easing").select("easing", "ramp_id", "ord", "r", "g", "b")


# --- random palettes, scales, merges ---------------------------------------------------------------------------------


def _draw_sql(slot: str, k: int) -> str:
    x = f"((seed*48271 + ({slot})*69621 + {(k + 1) * 16807}) % {hm.DRAW_MOD})"
    for _ in range(3):
        x = f"(({x}*48271 + 11) % {hm.DRAW_MOD})"
    return f"({x}/{hm.DRAW_MOD}e0)"


def _random_sql(n: int) -> str:
    h = f"({_draw_sql('-1', 0)}*360e0 + ord*{360 / n}e0 + {_draw_sql('ord', 1)}*20e0 - 10e0)"
    src = f"(select *, {h} as h, {_draw_sql('ord', 2)}*0.3e0+0.5e0 as s, {_draw_sql('ord', 3)}*0.3e0+0.4e0 as l from (select s_suppkey + 1 as seed from supplier) cross join (select cast(range as int) as ord from range({n})) q)"
    return f"select seed, ord, {o.from_hsl('h', 's', 'l')} from {src}"


@query("f11_random_palettes", _random_sql(5))
def random_palettes(spark, sf):
    seeds = d.table(spark, sf, "supplier").select((F.col("s_suppkey") + 1).alias("seed"))
    return hm.random_palettes(seeds, count=5).select("seed", "ord", "r", "g", "b")


@query(
    "f12_random_harmony",
    f"with bases as (select seed as base_id, r, g, b from ({_random_sql(1)})) select base_id as seed, ord, r, g, b from ({_expanded_sql('triadic', 6)})",
)
def random_harmony(spark, sf):
    seeds = d.table(spark, sf, "supplier").select((F.col("s_suppkey") + 1).alias("seed"))
    return hm.random_harmony(seeds, "triadic", 6).select("seed", "ord", "r", "g", "b")


def _scale_sql() -> str:
    walk, body = _mono_sql(10)
    labels = "[" + ",".join(map(str, K.SHADE_LABELS[10])) + "]"
    return _with_recursive(
        "bases", walk, f"select base_id, pos, {labels}[pos+1] as label, r, g, b from (select *, cast(row_number() over (partition by base_id order by {o.hsl_l()} desc, ord) - 1 as int) as pos from ({body}))"
    )


@query("f13_shade_scale", _scale_sql())
def shade_scale(spark, sf):
    return hm.shade_scale(d.bases(spark, sf), "base_id", 10)


@query(
    "f14_locked_merge",
    sql(
        "bases palettes",
        f""", gen as ({_expanded_sql('tetradic', 6)})
 select g.base_id as palette_id, g.ord, case when lk then p.r else g.r end as r, case when lk then p.g else g.g end as g, case when lk then p.b else g.b end as b, coalesce(lk, false) as locked
 from gen g left join (select *, (palette_id+ord) % 3 = 0 as lk from palettes) p on g.base_id = p.palette_id and g.ord = p.ord""",
    ),
)
def locked_merge(spark, sf):
    gen = hm.generate(d.bases(spark, sf), "tetradic", 6).withColumnRenamed("base_id", "palette_id")
    stored = d.palettes(spark, sf).withColumn("locked", (F.col("palette_id") + F.col("ord")) % 3 == 0)
    return hm.keep_locked(gen, stored)
