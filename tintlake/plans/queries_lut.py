"""Lattice queries: generation by three methods and application to pixels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lut
from ..operators import sinks
from . import derived as d
from . import oracle as o
from .derived import sql
from .registry import query

S = 5
# Few palettes of many colours, on larger lattices.
WIDE_S = 17
_WIDE = ", wide as (select palette_id % 5 as palette_id, row_number() over (partition by palette_id % 5 order by palette_id, ord) - 1 as ord, r, g, b from palettes)"


def wide(spark, sf):
    """All colours of the palettes in five palettes."""
    group = F.col("palette_id") % 5
    order = F.row_number().over(Window.partitionBy("group").orderBy("palette_id", "ord")) - 1
    rows = d.palettes(spark, sf).withColumn("group", group).withColumn("slot", order)
    return rows.select(F.col("group").alias("palette_id"), F.col("slot").alias("ord"), "r", "g", "b")


def _nodes_sql(src: str, size: str = str(S)) -> str:
    """``src`` rows crossed with the lattice nodes."""
    q = f"(select s.*, {size} as size, q.node from {src} s cross join (select cast(range as int) as node from range({max(6, int(size) if size.isdigit() else 0)**3})) q where q.node < {size}*{size}*{size})"
    axes = {"nr": "node % size", "ng": "(node // size) % size", "nb_": "node // (size*size)"}
    return "(select *, " + ", ".join(o.byte(f"(({v})/(size-1e0))") + f" as {n}" for n, v in axes.items()) + f" from {q})"


@query(
    "g1_identity_lattice",
    f"select palette_id, size, node, nr as r, ng as g, nb_ as b from {_nodes_sql('(select s_suppkey as palette_id, 2 + s_suppkey % 5 as sz from supplier)', 's.sz')}",
)
def identity_lattice(spark, sf):
    ids = d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("palette_id"))
    return lut.identity_lattice(ids, (F.col("palette_id") % 5 + 2).cast("int"))


def _cross(src: str = "palettes", size: int = S) -> str:
    pal = o.oklab(f"(select palette_id, ord, r as pr, g as pg, b as pb from {src})", "pr", "pg", "pb", "p_")
    return f"(select *, sqrt((n_l-p_l)*(n_l-p_l)+(n_a-p_a)*(n_a-p_a)+(n_b-p_b)*(n_b-p_b)) as dd from {o.oklab(_nodes_sql(pal, str(size)), 'nr', 'ng', 'nb_', 'n_')})"


def _arc(x: str, y: str, t: str) -> str:
    return o.wrap(f"{x} + ({y}-{x} - (case when {y}-{x} > 180 then 360e0 when {y}-{x} < -180 then -360e0 else 0e0 end))*{t}")


def _knn_sql(radius: float, dist: float, inten: float, k: int, sat: bool, *of) -> str:
    near = f"(select *, 1e0/(dd+1e-6) as w from {_cross(*of)} qualify row_number() over (partition by palette_id, node order by dd, ord) <= {k})"
    agg = f"""(select palette_id, size, node, n_l, n_c, n_h, pow(1e0 - least(min(dd)/{radius}e0, 1e0), {2 * dist}e0)*{inten}e0 as pull, sum(w*p_c)/sum(w) as tc,
     {o.wrap('degrees(atan2(sum(w*sin(radians(p_h))), sum(w*cos(radians(p_h)))))')} as th from {near} group by palette_id, size, node, n_l, n_c, n_h)"""
    nc = "n_c + (tc-n_c)*pull" if sat else "n_c"
    mixed = f"(select *, {nc} as nc, {_arc('n_h', 'th', 'pull')} as nh from {agg})"
    return "select palette_id, size, node, r, g, b from " + o.oklab_bytes(f"(select *, n_l as nl, nc*cos(radians(nh)) as na, nc*sin(radians(nh)) as nb from {mixed})")


@query("g2_knn_lattice", sql("palettes", _knn_sql(0.4, 0.15, 0.9, 2, False)))
def knn_lattice(spark, sf):
    return lut.make_lattice(d.palettes(spark, sf), "", size=S)


@query("g2_knn_lattice_chroma", sql("palettes", _knn_sql(0.6, 0.5, 0.8, 3, True)))
def knn_lattice_chroma(spark, sf):
    return lut.knn_lattice(d.palettes(spark, sf), S, 0.6, 0.5, 0.8, 3, True)


def _rbf_sql(reach: float, sharp: float, strength: float, sat: bool, *of) -> str:
    agg = f"""(select palette_id, size, node, n_l, n_a, n_b, n_c, sum(w) as sw, sum(w*p_a) as wa, sum(w*p_b) as wb from
     (select *, exp(-pow(dd/{reach}e0, {sharp}e0)) as w from {_cross(*of)}) group by all)"""
    t = f"(select *, n_a + ((case when sw > 1e-12 then wa/sw else n_a end)-n_a)*{strength}e0 as xa, n_b + ((case when sw > 1e-12 then wb/sw else n_b end)-n_b)*{strength}e0 as xb from {agg})"
    scale = "1e0" if sat else "(case when sqrt(xa*xa+xb*xb) > 1e-12 then n_c/sqrt(xa*xa+xb*xb) else 1e0 end)"
    return "select palette_id, size, node, r, g, b from " + o.oklab_bytes(f"(select *, n_l as nl, xa*{scale} as na, xb*{scale} as nb from {t})")


@query("g3_rbf_lattice", sql("palettes", _rbf_sql(0.2, 2.0, 0.9, False)))
def rbf_lattice(spark, sf):
    return lut.make_lattice(d.palettes(spark, sf), "rbf", size=S)


@query("g3_rbf_lattice_chroma", sql("palettes", _rbf_sql(0.3, 1.5, 0.7, True)))
def rbf_lattice_chroma(spark, sf):
    return lut.rbf_lattice(d.palettes(spark, sf), S, 0.3, 1.5, 0.7, True)


def _grade_sql(compression: float, mute: float, sat: bool, before: str = "", src: str = "palettes", size: int = S) -> str:
    """Anchors merged step by step in hue order, gaps by lead, gamut clip by nested halvings."""
    from ..functions import constants as K

    head = f"""{before}, ch as materialized (select palette_id, ok_h, ok_c, row_number() over (partition by palette_id order by ok_h, ord) as k from {o.oklab(src)} where ok_c >= 0.02),
 walk as (select palette_id, k, 1 as a, ok_h as h, ok_c as c from ch where k = 1
  union all select w.palette_id, ch.k, case when ch.ok_h - w.h < 2 then w.a else w.a + 1 end, case when ch.ok_h - w.h < 2 then (w.h+ch.ok_h)/2 else ch.ok_h end,
   case when ch.ok_h - w.h < 2 then (w.c+ch.ok_c)/2 else ch.ok_c end from walk w join ch on w.palette_id = ch.palette_id and ch.k = w.k + 1),
 anc as materialized (select palette_id, a, arg_max(h, k) as h, arg_max(c, k) as c from walk group by palette_id, a),
 gap as (select *, case when hi_h - lo_h <= 0 then hi_h - lo_h + 360 else hi_h - lo_h end as width from (select palette_id, a, count(*) over (partition by palette_id) as m, h as lo_h, c as lo_c,
  coalesce(lead(h) over w, first_value(h) over w) as hi_h, coalesce(lead(c) over w, first_value(c) over w) as hi_c from anc window w as (partition by palette_id order by a rows between unbounded preceding and unbounded following))),
 allgap as materialized (select p.palette_id, coalesce(m, 0) as m, a, lo_h, lo_c, hi_h, hi_c, width from (select distinct palette_id from {src}) p left join gap using (palette_id))
 """
    nodes = o.oklab(_nodes_sql("allgap", str(size)), "nr", "ng", "nb_", "n_")
    inside = f"(select *, least({o.wrap('n_h-lo_h')}/width, 1e0) as t from {nodes} where m <= 1 or (a = m and (n_h >= lo_h or n_h < hi_h)) or (a < m and n_h >= lo_h and n_h < hi_h))"
    g = repr(6.0**compression)
    bent = f"(select *, case when t <= 0 then 0e0 when t >= 1 then 1e0 else pow(t,{g})/(pow(t,{g})+pow(1e0-t,{g})) end as bent from {inside})"
    w = f"(select *, coalesce({o.wrap('lo_h+bent*width')}, n_h) as wh, coalesce(lo_c+(hi_c-lo_c)*bent, 0e0) as wc, least(greatest(coalesce(least(t,1e0-t)*width/90e0,0e0),0e0),1e0) as edge from {bent})"
    c = "n_c + (wc-n_c)*" + f"{compression}e0" if sat and compression > 0 else "n_c"
    c = f"(case when m > 0 then ({c})*(1e0-{mute}e0*edge*edge*(3e0-2e0*edge)) else {c} end)"
    q = f"(select *, c0 as hi, 0e0 as lo from (select *, {c} as c0, cos(radians(wh)) as _cos, sin(radians(wh)) as _sin from {w}))"

    def fits(v):
        cubes = [f"pow(n_l + {o.num(wa)}*({v}*_cos) + {o.num(wb)}*({v}*_sin), 3)" for wa, wb in K.OKLAB_TO_LMS]
        return " and ".join(f"{o.mix(row, cubes)} between -1e-4 and 1.0001e0" for row in K.OKLAB_LMS_TO_RGB)

    for _ in range(16):
        q = f"(select * exclude (lo, hi, fit), case when fit then (lo+hi)/2 else lo end as lo, case when fit then hi else (lo+hi)/2 end as hi from (select *, {fits('((lo+hi)/2)')} as fit from {q}))"
    done = f"(select *, case when c0 <= 0 then 0e0 when {fits('c0')} then c0 else lo end as nc from {q})"
    rgb = o.oklab_bytes(f"(select *, n_l as nl, nc*_cos as na, nc*_sin as nb from {done})")
    idle = "m = 0" if not (sat and compression > 0) else "false"
    body = f"select palette_id, size, node, case when {idle} then nr else r end as r, case when {idle} then ng else g end as g, case when {idle} then nb_ else b end as b from {rgb}"
    return sql("palettes", head + body).replace("with ", "with recursive ", 1)


@query("g4_grade_lattice", _grade_sql(0.7, 0.3, False))
def grade_lattice(spark, sf):
    return lut.make_lattice(d.palettes(spark, sf), "grade", size=S)


@query("g4_grade_lattice_chroma", _grade_sql(0.4, 0.5, True))
def grade_lattice_chroma(spark, sf):
    return lut.grade_lattice(d.palettes(spark, sf), S, 0.4, 0.5, True)


_OF_WIDE = ("wide", WIDE_S)


@query("g2_wide_lattice", sql("palettes", _WIDE + " " + _knn_sql(0.4, 0.15, 0.9, 2, False, *_OF_WIDE)))
def wide_knn_lattice(spark, sf):
    return lut.make_lattice(wide(spark, sf), "", size=WIDE_S)


@query("g3_wide_lattice", sql("palettes", _WIDE + " " + _rbf_sql(0.2, 2.0, 0.9, False, *_OF_WIDE)))
def wide_rbf_lattice(spark, sf):
    return lut.make_lattice(wide(spark, sf), "rbf", size=WIDE_S)


@query("g4_wide_lattice", _grade_sql(0.7, 0.3, False, _WIDE, *_OF_WIDE))
def wide_grade_lattice(spark, sf):
    return lut.make_lattice(wide(spark, sf), "grade", size=WIDE_S)


_JOB = {
    "job_id": "c_custkey",
    "method": "case c_custkey % 5 when 0 then '' when 1 then 'knn' when 2 then 'rbf' when 3 then 'grade' else 'cube' end",
    "size": "c_custkey % 300",
    "radius": "(c_custkey % 7 - 1)/4e0",
    "distribution": "(c_custkey % 11)/9e0",
    "intensity": "(c_custkey % 13)/12e0",
    "reach": "(c_custkey % 9)/10e0",
    "sharpness": "(c_custkey % 8)/2e0",
    "strength": "(c_custkey % 6)/4e0",
    "compression": "(c_custkey % 10 - 1)/8e0",
    "mute": "(c_custkey % 14)/12e0",
}


@query(
    "g5_lattice_jobs",
    "with jobs as (select " + ", ".join(f"{e} as {n}" for n, e in _JOB.items()) + """ from customer), r as (select *, case when method = '' then 'knn' else method end as m2 from jobs)
 select job_id, m2 as method, case when size < 2 then 33 else size end as size, case when size > 256 then 'size above 256' when m2 not in ('knn','rbf','grade') then 'unknown method'
  when m2='knn' and radius < 0 then 'radius below 0' when m2='knn' and (distribution < 0 or distribution > 1) then 'distribution outside 0..1'
  when m2='knn' and (intensity < 0 or intensity > 1) then 'intensity outside 0..1' when m2='rbf' and reach <= 0 then 'reach not above 0' when m2='rbf' and sharpness <= 0 then 'sharpness not above 0'
  when m2='rbf' and (strength < 0 or strength > 1) then 'strength outside 0..1' when m2='grade' and (compression < 0 or compression > 1) then 'compression outside 0..1'
  when m2='grade' and (mute < 0 or mute > 1) then 'mute outside 0..1' end as error from r""",
)
def lattice_jobs(spark, sf):
    jobs = d.ints(d.table(spark, sf, "customer"), **_JOB)
    return lut.check_jobs(jobs).select("job_id", "method", "size", "error")


def _run_jobs_sql() -> str:
    made = [
        f"select palette_id as job_id, size, node, r, g, b from ({_rbf_sql(0.2, 2.0, 0.9, False)}) where palette_id % 2 = 0",
        f"select palette_id, size, node, r, g, b from ({_rbf_sql(0.3, 1.5, 0.7, False)}) where palette_id % 2 = 1",
        f"select palette_id + 1000, size, node, r, g, b from ({_knn_sql(0.4, 0.15, 0.9, 2, False)})",
    ]
    return sql("palettes", " " + " union all ".join(made))


@query("g5_run_jobs", _run_jobs_sql())
def run_lattice_jobs(spark, sf):
    palettes = d.palettes(spark, sf)
    ids = palettes.select("palette_id").distinct()
    even = F.col("palette_id") % 2 == 0
    same = {"size": F.lit(S), "radius": F.lit(0.4), "distribution": F.lit(0.15), "intensity": F.lit(0.9), "compression": F.lit(0.0), "mute": F.lit(0.0)}
    rbf = ids.select(F.col("palette_id").alias("job_id"), "palette_id", F.lit("rbf").alias("method"), F.when(even, 0.2).otherwise(0.3).alias("reach"), F.when(even, 2.0).otherwise(1.5).alias("sharpness"), F.when(even, 0.9).otherwise(0.7).alias("strength"))
    knn = ids.select((F.col("palette_id") + 1000).alias("job_id"), "palette_id", F.lit("").alias("method"), *[F.lit(1.0).alias(k) for k in ("reach", "sharpness", "strength")])
    return lut.run_jobs(palettes, rbf.unionByName(knn).withColumns(same))[0]


def _apply_sql(lat: str, palettes: int = 25, size: int = S, before: str = "") -> str:
    at = ", ".join(f"least(cast(floor({c}/255e0*{size - 1}e0) as int), {size - 2}) as i{c}" for c in "rgb")
    fr = ", ".join(f"{c}/255e0*{size - 1}e0 - i{c} as f{c}" for c in "rgb")
    wts = "*".join(f"(case when d{c} = 1 then f{c} else 1e0-f{c} end)" for c in "rgb")
    outs = ", ".join(f"cast(floor(sum(l.{c}*w)+0.5) as int) as out_{c}" for c in "rgb")
    return sql(
        "pixels palettes",
        f"""{before}, lat as materialized ({lat}), col as (select distinct image_id % {palettes} as palette_id, r, g, b from pixels),
 pos as (select *, {fr} from (select *, {at} from col)),
 cor as (select *, (ir+dr)+(ig+dg)*{size}+(ib+db)*{size * size} as node, {wts} as w from pos cross join (values (0),(1)) a(dr) cross join (values (0),(1)) bb(dg) cross join (values (0),(1)) cc(db)),
 done as (select cor.palette_id, cor.r, cor.g, cor.b, {outs} from cor join lat l on cor.palette_id = l.palette_id and cor.node = l.node group by cor.palette_id, cor.r, cor.g, cor.b)
 select image_id, idx, palette_id, out_r, out_g, out_b from pixels join done on image_id % {palettes} = palette_id and pixels.r = done.r and pixels.g = done.g and pixels.b = done.b""",
    )


def _applied(spark, sf, lattice, palettes):
    assigned = d.images(spark, sf).select("image_id", (F.col("image_id") % palettes).alias("palette_id"), "n_total")
    return lut.apply_lattice(d.pixels(spark, sf), assigned, lattice)


@query("g6_apply_lattice", _apply_sql(_rbf_sql(0.2, 2.0, 0.9, False)))
def apply_lattice(spark, sf):
    return _applied(spark, sf, lut.make_lattice(d.palettes(spark, sf), "rbf", size=S), 25)


@query("g6_apply_wide_lattice", _apply_sql(_knn_sql(0.4, 0.15, 0.9, 2, False, *_OF_WIDE), 5, WIDE_S, _WIDE))
def apply_wide_lattice(spark, sf):
    return _applied(spark, sf, lut.make_lattice(wide(spark, sf), "", size=WIDE_S), 5)


@query(
    "a10_lattice_text",
    sql("palettes", f"select palette_id, -1 as pos, 'LUT_3D_SIZE 5' as line from (select distinct palette_id from palettes) union all select palette_id, node, printf('%.6f %.6f %.6f', r/255e0, g/255e0, b/255e0) from ({_rbf_sql(0.2, 2.0, 0.9, False)})"),
)
def lattice_text(spark, sf):
    return sinks.lattice_lines(lut.make_lattice(d.palettes(spark, sf), "rbf", size=S)).select("palette_id", "pos", "line")
