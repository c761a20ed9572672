"""Palette extraction queries over the derived pixel table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import kernel
from ..operators import clusters as cl
from ..operators import extract as ex
from ..operators import jobs as jb
from ..operators import pixels as px
from ..operators import quantise as qz
from . import derived as d
from . import oracle as o
from .derived import sql
from .queries_color import micro
from .registry import query

PALETTE_COLS = ["image_id", "ord", "r", "g", "b", "n"]


def valid(spark, sf):
    return px.opaque(d.colours(spark, sf))


def placed(spark, sf):
    return px.opaque(d.pixels(spark, sf))


def shown(palette):
    return palette.select(*PALETTE_COLS, micro("freq").alias("freq"))


_V = ", px as (select * from pixels where a >= 1)"


def _bins(bits: int, group: str = "image_id") -> str:
    s = 8 - bits
    return (
        f"select {group}, (r >> {s}) * {1 << (2 * bits)} + (g >> {s}) * {1 << bits} + (b >> {s}) as key, count(*) as n,"
        f" cast(sum(r)//count(*) as int) as r, cast(sum(g)//count(*) as int) as g, cast(sum(b)//count(*) as int) as b from px group by {group}, 2"
    )


@query("c1_histogram", sql("pixels", f"{_V} {_bins(5)}"))
def histogram(spark, sf):
    return px.histogram(valid(spark, sf), 5)


@query("c1_histogram_3bit", sql("pixels", f"{_V} {_bins(3)}"))
def histogram_3bit(spark, sf):
    return px.histogram(valid(spark, sf), 3)


def _popular(group: str = "image_id", k: int = 5) -> str:
    return f"""select {group}, ord, r, g, b, n, {o.micro(f'n / sum(n) over (partition by {group})')} as freq from (
 select *, cast(row_number() over (partition by {group} order by n desc, key) - 1 as int) as ord from ({_bins(5, group)})) where ord < {k}"""


@query("c2_popularity", sql("pixels", f"{_V} {_popular()}"))
def popularity(spark, sf):
    return shown(qz.popularity(valid(spark, sf)))


def _median_cut_sql(k: int) -> str:
    parts = ["b0 as materialized (select image_id, r, g, b, '' as path from px)"]
    for i in range(k - 1):
        parts.append(
            f"p{i} as materialized (select *, case when wr >= wg and wr >= wb then 0 when wg >= wb then 1 else 2 end as axis from (select image_id, path, count(*) as size, max(r)-min(r) as wr,"
            f" max(g)-min(g) as wg, max(b)-min(b) as wb from b{i} group by image_id, path) where size > 1 qualify row_number() over (partition by image_id order by size desc, path) = 1)"
        )
        parts.append(
            f"b{i + 1} as materialized (select image_id, r, g, b, case when size is null then path when row_number() over (partition by image_id, size is null order by"
            f" case axis when 0 then r when 1 then g else b end, r, g, b) <= size // 2 then path || '0' else path || '1' end as path"
            f" from (select b.*, p.size, p.axis from b{i} b left join p{i} p on b.image_id = p.image_id and b.path = p.path))"
        )
    return (
        ", " + ", ".join(parts) + f" select image_id, cast(row_number() over (partition by image_id order by path) - 1 as int) as ord, cast(sum(r)//count(*) as int) as r, cast(sum(g)//count(*) as int) as g,"
        f" cast(sum(b)//count(*) as int) as b, count(*) as n, {o.micro('count(*) / sum(count(*)) over (partition by image_id)')} as freq from b{k - 1} group by image_id, path"
    )


@query("c3_median_cut", sql("pixels", _V + _median_cut_sql(5)))
def median_cut(spark, sf):
    return shown(qz.median_cut(valid(spark, sf)))


def _wu_sql(k: int) -> str:
    parts = [
        "s0 as materialized (select image_id, r>>3 as p0, g>>3 as p1, b>>3 as p2, count(*) as n, sum(r) as sr, sum(g) as sg, sum(b) as sb, sum(r*r+g*g+b*b) as sq, 0 as box from px group by 1,2,3,4)"
    ]

    def energy(n, *sums):
        return "((" + "+".join(f"({s})::double*({s})::double" for s in sums) + f")/({n})::double)"

    for i in range(k - 1):
        parts.append(
            f"x{i} as materialized (select *, sq::double - {energy('n', 'sr', 'sg', 'sb')} as res, max(box) over (partition by image_id) + 1 as fresh from (select image_id, box, count(*) as bins,"
            f" sum(n) as n, sum(sr) as sr, sum(sg) as sg, sum(sb) as sb, sum(sq) as sq from s{i} group by image_id, box))"
        )
        parts.append(f"k{i} as materialized (select * from x{i} where bins > 1 and res > 0 qualify row_number() over (partition by image_id order by res desc, box) = 1)")
        axes = " union all ".join(f"select image_id, box, {a} as axis, p{a} as pos, n, sr, sg, sb from s{i}" for a in range(3))
        cums = ", ".join(f"sum({c}) over (partition by image_id, axis order by pos) as c_{c}" for c in ("n", "sr", "sg", "sb"))
        parts.append(
            f"e{i} as (select image_id, box, axis, pos, sum(n) as n, sum(sr) as sr, sum(sg) as sg, sum(sb) as sb from ({axes}) join (select image_id, box from k{i}) using (image_id, box) group by 1,2,3,4)"
        )
        parts.append(
            f"g{i} as materialized (select q.image_id, q.box, fresh, axis, pos from (select *, {cums} from e{i}) q join k{i} k on q.image_id = k.image_id where c_n < k.n"
            f" qualify row_number() over (partition by q.image_id order by {energy('c_n', 'c_sr', 'c_sg', 'c_sb')} + {energy('k.n-c_n', 'k.sr-c_sr', 'k.sg-c_sg', 'k.sb-c_sb')} desc, axis, pos) = 1)"
        )
        parts.append(
            f"s{i + 1} as materialized (select s.image_id, p0, p1, p2, n, sr, sg, sb, sq, case when s.box = g.box and (case axis when 0 then p0 when 1 then p1 else p2 end) > pos then fresh else s.box end as box"
            f" from s{i} s left join g{i} g on s.image_id = g.image_id)"
        )
    return (
        ", " + ", ".join(parts) + f" select image_id, box as ord, cast(sum(sr)//sum(n) as int) as r, cast(sum(sg)//sum(n) as int) as g, cast(sum(sb)//sum(n) as int) as b, cast(sum(n) as bigint) as n,"
        f" {o.micro('sum(n) / sum(sum(n)) over (partition by image_id)')} as freq from s{k - 1} group by image_id, box"
    )


@query("c4_wu", sql("pixels", _V + _wu_sql(5)))
def wu(spark, sf):
    return shown(qz.wu(valid(spark, sf)))


def _octree_sql(k: int = 5) -> str:
    """Leaves at the shallowest level of k nodes, then per level the lightest groups that the budget allows, one after
    another by recursion, then nearest-pair merges (at most seven nodes are over)."""
    path = " + ".join(f"((((r >> {7 - i}) & 1) * 4 + ((g >> {7 - i}) & 1) * 2 + ((b >> {7 - i}) & 1))::bigint << {3 * (7 - i)})" for i in range(8))
    sums = ", ".join(f"sum({c})::bigint as {c}" for c in ("n", "sr", "sg", "sb"))
    parts = [
        f"hs as materialized (select image_id, {path} as path, count(*) as n, sum(r) as sr, sum(g) as sg, sum(b) as sb from px group by image_id, r, g, b)",
        "dp as (select image_id, d, count(distinct path >> (3*(8-d))) as nodes from hs cross join range(1, 9) t(d) group by image_id, d)",
        f"lv as materialized (select image_id, coalesce(min(case when nodes >= {k} then d end), 8) as depth from dp group by image_id)",
        f"l0 as materialized (select image_id, depth, path >> (3*(8-depth)) as node, {sums} from hs join lv using (image_id) group by all)",
    ]
    for j in range(1, 9):
        parts.append(
            f"g{j} as materialized (select *, row_number() over (partition by image_id order by total, parent) as rk, sum(cnt) over (partition by image_id)::bigint as len"
            f" from (select image_id, node >> {3 * j} as parent, count(*) as cnt, sum(n) as total from l{j - 1} where depth >= {j} group by 1, 2))"
        )
        hit = f"g.cnt > 1 and g.cnt <= w.len - {k - 1}"
        parts.append(
            f"w{j} as (select image_id, 0::bigint as rk, min(len) as len, -1::bigint as parent, false as hit from g{j} group by image_id union all"
            f" select g.image_id, g.rk, case when {hit} then w.len - g.cnt + 1 else w.len end, g.parent, {hit} from w{j} w join g{j} g on g.image_id = w.image_id and g.rk = w.rk + 1)"
        )
        parts.append(
            f"l{j} as materialized (select l.image_id, depth, min(node) as node, {sums} from l{j - 1} l left join w{j} w on w.image_id = l.image_id and w.hit and w.parent = l.node >> {3 * j} and depth >= {j}"
            f" group by l.image_id, depth, case when w.hit then -1 - w.parent else node end)"
        )
    parts.append("q0 as materialized (select image_id, node, n, sr, sg, sb from l8)")
    d2 = "+".join(f"(x.ok_{c}-y.ok_{c})*(x.ok_{c}-y.ok_{c})" for c in "lab")
    for i in range(7):
        mean = f"(select *, (sr//n)::int as r, (sg//n)::int as g, (sb//n)::int as b from q{i} where image_id in (select image_id from q{i} group by image_id having count(*) > {k}))"
        parts.append(f"o{i} as materialized (select * from {o.oklab(mean)})")
        parts.append(f"t{i} as materialized (select x.image_id, x.node as ni, y.node as nj from o{i} x join o{i} y on x.image_id = y.image_id and x.node < y.node qualify row_number() over (partition by x.image_id order by {d2}, x.node, y.node) = 1)")
        parts.append(f"q{i + 1} as materialized (select q.image_id, case when node = nj then ni else node end as node, {sums} from q{i} q left join t{i} t on q.image_id = t.image_id group by 1, 2)")
    tail = f" select image_id, row_number() over (partition by image_id order by node) - 1 as ord, (sr//n)::int as r, (sg//n)::int as g, (sb//n)::int as b, n, {o.micro('n / sum(n) over (partition by image_id)')} as freq from q7"
    return sql("pixels", _V + ", " + ", ".join(parts) + tail).replace("with ", "with recursive ", 1)


@query("c5_octree", _octree_sql())
def octree(spark, sf):
    return shown(qz.octree(valid(spark, sf)))


# Rounds that the oracle unrolls: at rest, further rounds change nothing. The queries themselves go on to rest.
SQL_ROUNDS = 30
CLUSTERS = 5 * K.CLUSTERS_PER_COLOR


def _lloyd_sql(points: str, k: int, rounds: int, key: str = "image_id") -> str:
    """Tables ``pt`` (points with their centres' number c) from points (key, pos, w, f0..f2, ...)."""
    near = lambda c: "+".join(f"(p.f{q}-{c}.f{q})*(p.f{q}-{c}.f{q})" for q in range(3))
    rank = lambda m: f"case when {m} > 0 then floor(ln({m} + 1e0) * 1e6)::bigint * 16777216 + 16777215 - p.pos end"
    one = "{'f0': f0, 'f1': f1, 'f2': f2}"
    parts = [
        f"lp as materialized (select * replace (round(f0, 6) as f0, round(f1, 6) as f1, round(f2, 6) as f2) from ({points}))",
        f"s0 as materialized (select {key}, [arg_max({one}, rk)] as cs from (select p.*, {rank('p.w::double')} as rk from lp p) group by {key})",
    ]
    for i in range(1, k):
        mass = f"(p.w * list_min([{near('c')} for c in cs]))"
        parts.append(
            f"s{i} as materialized (select {key}, case when max(rk) is null then any_value(cs) else list_append(any_value(cs), arg_max({one}, rk)) end as cs"
            f" from (select p.*, s.cs, {rank(mass)} as rk from lp p join s{i - 1} s using ({key})) group by {key})"
        )
    parts.append(f"r0 as materialized (select {key}, cs, cs[1] as lead from s{k - 1})")
    labels = f"(select *, list_position(ds, list_min(ds)) - 1 as c from (select p.*, s.cs, [{near('c')} for c in cs] as ds from lp p join r{{i}} s using ({key})))"
    for i in range(rounds):
        mean = ", ".join(f"'f{q}': round(sum(f{q}*w)/sum(w), 6)" for q in range(3))
        parts.append(f"m{i} as materialized (select {key}, c, {{{mean}}} as mean from {labels.format(i=i)} group by {key}, c)")
        parts.append(
            f"r{i + 1} as materialized (select u.{key}, list(coalesce(m.mean, u.lead) order by u.slot) as cs, any_value(u.lead) as lead"
            f" from (select {key}, lead, unnest(range(len(cs))) as slot from r{i}) u left join m{i} m on m.{key} = u.{key} and m.c = u.slot group by u.{key})"
        )
    parts.append(f"pt as materialized (select * exclude (cs, ds) from {labels.format(i=rounds)})")
    return ", " + ", ".join(parts)


def _points_sql(space: str, key: str = "image_id", extra: str = "") -> str:
    fold = f"(select {key}{extra}, r, g, b, count(*) as w, r*65536 + g*256 + b as pos from px group by {key}{extra}, r, g, b)"
    if space == "lab":
        return f"select *, lab_l as f0, lab_a as f1, lab_b as f2 from {o.lab(fold)}"
    return f"select *, ok_l*100 as f0, ok_a*100 as f1, ok_b*100 as f2 from {o.oklab(fold)}"


def _kmeans_sql(space: str) -> str:
    means = ", ".join(f"sum(f{q}*w)/sum(w) as f{q}" for q in range(3))
    cl_ = f"(select image_id, c, {means}, sum(w) as n from pt group by image_id, c)"
    rgb = o.lab_bytes(f"(select *, f0 as nl, f1 as na, f2 as nb from {cl_})") if space == "lab" else o.oklab_bytes(f"(select *, f0/100 as nl, f1/100 as na, f2/100 as nb from {cl_})")
    tail = f" select image_id, row_number() over (partition by image_id order by c) - 1 as ord, r, g, b, n::bigint as n, {o.micro('n / sum(n) over (partition by image_id)')} as freq from {rgb}"
    return sql("pixels", _V + _lloyd_sql(_points_sql(space), 5, SQL_ROUNDS) + tail)


@query("c6_kmeans", _kmeans_sql("lab"))
def kmeans(spark, sf):
    return shown(cl.kmeans(placed(spark, sf)))


@query("c7_okkmeans", _kmeans_sql("oklab"))
def okkmeans(spark, sf):
    return shown(cl.kmeans(placed(spark, sf), space="oklab"))


def _merges_sql(rounds: int, radius: float | None, floor: int) -> str:
    """Tables u1.. from ``u0`` (image_id, c, f0..f2, n, s): in each the nearest pair of every image is merged."""
    parts = []
    d2 = "+".join(f"(x.f{q}-y.f{q})*(x.f{q}-y.f{q})" for q in range(3))
    mean = ", ".join(f"(x.f{q}*x.n+y.f{q}*y.n)/(x.n+y.n) as f{q}" for q in range(3))
    near = f"{d2} < {radius * radius!r}" if radius else "true"
    for i in range(rounds):
        many = f"x.image_id in (select image_id from u{i} group by image_id having count(*) > {floor})"
        parts.append(
            f"v{i} as materialized (select x.image_id, x.c as ci, y.c as cj, {mean}, x.n+y.n as n, x.s+y.s as s from u{i} x join u{i} y on x.image_id = y.image_id and x.c < y.c"
            f" where {near} and {many} qualify row_number() over (partition by x.image_id order by {d2}, x.c, y.c) = 1)"
        )
        parts.append(
            f"u{i + 1} as materialized (select m.* from u{i} m left join v{i} t on m.image_id = t.image_id and (m.c = ci or m.c = cj) where ci is null"
            f" union all select image_id, ci, f0, f1, f2, n, s from v{i})"
        )
    return ", " + ", ".join(parts)


def _wkmeans_sql(k: int = 5) -> str:
    sal = f"ln(n + 1e0) * pow(0.05e0 + {o.hsl_s()}, 1.5e0)"
    points = f"select *, key as pos, {sal} as w, ok_l*100 as f0, ok_a*100 as f1, ok_b*100 as f2 from {o.oklab(f'({_bins(5)})')}"
    means = ", ".join(f"sum(f{q}*n)/sum(n) as f{q}" for q in range(3))
    u0 = f", u0 as materialized (select image_id, c, {means}, sum(n)::double as n, sum(w) as s from pt group by image_id, c)"
    top = f"(select *, f0/100 as nl, f1/100 as na, f2/100 as nb, row_number() over (partition by image_id order by s desc, c) - 1 as ord from u{CLUSTERS - 1} qualify ord < {k})"
    tail = f" select image_id, ord, r, g, b, n::bigint as n, {o.micro('n / sum(n) over (partition by image_id)')} as freq from {o.oklab_bytes(top)}"
    return sql("pixels", _V + _lloyd_sql(points, CLUSTERS, SQL_ROUNDS) + u0 + _merges_sql(CLUSTERS - 1, K.WEIGHTED_MERGE_DISTANCE, 1) + tail)


@query("c8_wkmeans", _wkmeans_sql())
def wkmeans(spark, sf):
    return shown(cl.weighted_kmeans(valid(spark, sf)))


def _soft_sql(count_stop: bool, k: int = 5) -> str:
    rule = cl.preset_rule("default")
    tests = [t for bound, t in (("min_l", "ok_l >= {}"), ("max_l", "ok_l <= {}"), ("min_c", "ok_c >= {}"), ("max_c", "ok_c <= {}")) if rule[bound] for t in [t.format(rule[bound])]]
    hit = " and ".join(tests) or "true"
    kept = f", hits as (select *, {hit} as hit from {o.oklab('(select * from pixels where a >= 1)')}), fb as (select image_id, count(*) filter (where hit) < {k} as fell_back from hits group by image_id)"
    px_ = ", px as (select image_id, r, g, b, fell_back from hits join fb using (image_id) where hit or fell_back)"
    means = ", ".join(f"sum(f{q}*w)/sum(w) as f{q}" for q in range(3))
    first = o.lab_bytes(f"(select *, f0 as nl, f1 as na, f2 as nb from (select image_id, c, {means}, sum(w)::double as n from pt group by image_id, c))")
    u0 = f", u0 as materialized (select image_id, c, lab_l as f0, lab_a as f1, lab_b as f2, n, 0e0 as s from {o.lab(f'(select image_id, c, r, g, b, n from {first})')})"
    radius, floor = (None, max(int(k * 1.5 + 0.5), 1)) if count_stop else (K.SOFT_MERGE_DISTANCE, k)
    rgb = o.lab_bytes(f"(select *, f0 as nl, f1 as na, f2 as nb from u{CLUSTERS - 1})")
    weight = f"n * (pow(ok_c, {float(rule['exponent'])!r}) + {float(rule['bias'])!r})"
    if rule["prefer_l"]:
        weight += f" * greatest(0e0, (ok_l * 2e0 - 1e0) * {float(rule['prefer_l'])!r} + 1e0)"
    top = f"(select *, row_number() over (partition by image_id order by {weight} desc, c) - 1 as ord from {o.oklab(f'(select image_id, c, r, g, b, n from {rgb})')} qualify ord < {k})"
    tail = f" select image_id, ord, r, g, b, n::bigint as n, {o.micro('n / sum(n) over (partition by image_id)')} as freq, fell_back from {top} join fb using (image_id)"
    return sql("pixels", kept + px_ + _lloyd_sql(_points_sql("lab"), CLUSTERS, SQL_ROUNDS) + u0 + _merges_sql(CLUSTERS - 1, radius, floor) + tail)


@query("c9_soft", _soft_sql(False))
def soft(spark, sf):
    return cl.soft(placed(spark, sf)).select(*PALETTE_COLS, micro("freq").alias("freq"), "fell_back")


@query("c10_softk", _soft_sql(True))
def softk(spark, sf):
    return cl.soft(placed(spark, sf), count_stop=True).select(*PALETTE_COLS, micro("freq").alias("freq"), "fell_back")


def _mood_sql(p: str) -> str:
    lo, hi, cmin, cmax = K.MOOD_PRESETS[p][:4]
    tests = [f"ok_l >= {lo}", f"ok_l <= {hi}", f"ok_c >= {cmin}"] + ([f"ok_c <= {cmax}"] if cmax else [])
    return " and ".join(tests)


@query(
    "c11_mood_filter",
    sql("pixels", f"{_V} select image_id, " + ", ".join(f"count(*) filter (where {_mood_sql(p)}) as n_{p}" for p in K.MOOD_PRESETS) + f" from {o.oklab('px')} group by image_id"),
)
def mood_filter(spark, sf):
    hist = px.color_counts(valid(spark, sf))
    flags = cl.mood_flags(hist, list(K.MOOD_PRESETS))
    counts = [F.sum(F.when(F.col(f"in_{p}"), F.col("n")).otherwise(0)).alias(f"n_{p}") for p in K.MOOD_PRESETS]
    return flags.groupBy("image_id").agg(*counts)


@query(
    "c12_filter_fallback",
    sql(
        "pixels",
        f"""{_V}, m as (select *, ok_l >= 0.55 and ok_l <= 0.8 and ok_c >= 0.165 as hit from {o.oklab('px')}), f as (select image_id, count(*) filter (where hit) < 70 as fell_back from m group by image_id)
 select image_id, idx, fell_back from m join f using (image_id) where hit or fell_back""",
    ),
)
def filter_fallback(spark, sf):
    rule = cl.preset_rule("bright", min_l=0.55, max_l=0.8, min_c=0.165)
    return cl.mood_filter(placed(spark, sf), rule, 70).select("image_id", "idx", "fell_back")


@query(
    "c13_source_pixels",
    sql(
        "pixels",
        f"""{_V}, pal as ({_popular()}), sh as (select image_id, idx, case when a=0 then 0 else r end as r, case when a=0 then 0 else g end as g, case when a=0 then 0 else b end as b from pixels),
 best as (select p.image_id, p.ord, s.idx from pal p join sh s on p.image_id = s.image_id
  qualify row_number() over (partition by p.image_id, p.ord order by (s.r-p.r)*(s.r-p.r)+(s.g-p.g)*(s.g-p.g)+(s.b-p.b)*(s.b-p.b), s.idx) = 1)
 select image_id, ord, r, g, b, {o.micro('(idx % w + 0.5)/w')} as src_x, {o.micro('(idx // w + 0.5)/h')} as src_y from pal join best using (image_id, ord) join images using (image_id)""",
    ),
)
def source_pixels(spark, sf):
    pixels = d.pixels(spark, sf)
    out = qz.annotate(qz.popularity(valid(spark, sf)), pixels, d.images(spark, sf))
    return out.select("image_id", "ord", "r", "g", "b", micro("src_x").alias("src_x"), micro("src_y").alias("src_y"))


@query(
    "c14_provenance",
    sql("pixels", ", t as (select image_id, count(*) as n_total, count(*) filter (where a >= 1) as n_valid from pixels group by image_id) select image_id, 'popularity' as method, '5' as palette_size, w, h, n_total > n_valid as has_masked, n_total, n_valid from t join images using (image_id, n_total)"),
)
def provenance(spark, sf):
    stats = px.pixel_stats(d.colours(spark, sf))
    out = qz.provenance(stats, d.images(spark, sf), "popularity", {"palette_size": "5"})
    return out.withColumn("palette_size", F.col("params")["palette_size"]).drop("params")


@query(
    "c15_saliency",
    sql("pixels", f"{_V} select image_id, key, {o.micro(f'ln(n + 1e0) * pow(0.05e0 + {o.hsl_s()}, 1.5e0)')} as saliency from ({_bins(5)})"),
)
def saliency(spark, sf):
    s = kernel.hsl_saturation(*[F.col(c) for c in "rgb"])
    return px.histogram(valid(spark, sf)).select("image_id", "key", micro(kernel.saliency(F.col("n"), s)).alias("saliency"))


def _grouped_sql() -> str:
    means = ", ".join(f"floor(sum(f{q}*w)/sum(w)*1000)::bigint as f{q}" for q in range(3))
    return sql("pixels", _V + _lloyd_sql(_points_sql("oklab"), 8, SQL_ROUNDS) + f" select image_id, c, {means}, sum(w)::bigint as n from pt group by image_id, c")


@query("c16_grouped_lloyd", _grouped_sql())
def grouped_lloyd(spark, sf):
    points = cl.cluster_points(cl.color_points(placed(spark, sf), "oklab"), 8)
    out = cl._cluster_means(points, F.col("w"), F.lit(0), "image_id")
    return out.select("image_id", "c", *[F.floor(F.col(f) * 1000).cast("bigint").alias(f) for f in cl.FEATURES], F.col("n").cast("bigint").alias("n"))


def _density_sql(tail: str) -> str:
    """Neighbour pairs, core bins, reachability closed by recursion, then the earliest touching cluster."""
    feat = f"(select image_id, key, n, r, g, b, ok_l*100 as f0, ok_a*100 as f1, ok_b*100 as f2 from {o.oklab(f'({_bins(5)})')})"
    return sql(
        "pixels",
        f"""{_V}, f as materialized (select * from {feat}),
 nb as materialized (select x.image_id, x.key as i, y.key as j, y.n as wj from f x join f y on x.image_id = y.image_id and (x.f0-y.f0)*(x.f0-y.f0)+(x.f1-y.f1)*(x.f1-y.f1)+(x.f2-y.f2)*(x.f2-y.f2) <= 36e0),
 core as materialized (select image_id, i as key from nb group by image_id, i having sum(wj) >= 4),
 link as materialized (select nb.image_id, i, j from nb join core a on nb.image_id=a.image_id and nb.i=a.key join core b on nb.image_id=b.image_id and nb.j=b.key),
 reach as (select image_id, key as root, key from core union select r.image_id, r.root, j from reach r join link l on r.image_id=l.image_id and r.key=l.i),
 lab as materialized (select image_id, key, min(root) as cluster from reach group by image_id, key),
 every as (select nb.image_id, nb.j as key, min(cluster) as cluster from nb join lab on nb.image_id=lab.image_id and nb.i=lab.key group by 1, 2),
 fin as materialized (select image_id, key, coalesce(lab.cluster, every.cluster) as cluster from every left join lab using (image_id, key)) {tail}""",
    ).replace("with ", "with recursive ", 1)


_LABELS = """ select image_id, key, dense_rank() over (partition by image_id order by cluster) as c from fin union all select image_id, key, 0 from f where (image_id, key) not in (select (image_id, key) from fin)"""


def _dbscan_sql(k: int = 5) -> str:
    """Clusters ranked by summed saliency, then up to k padding steps by distance times saliency."""
    sal = f"ln(n + 1e0) * pow(0.05e0 + {o.hsl_s()}, 1.5e0)"
    means = ", ".join(f"sum(f{q}*n)/sum(n) as f{q}" for q in range(3))
    d2 = "+".join(f"(b.f{q}-c.f{q})*(b.f{q}-c.f{q})" for q in range(3))
    parts = [
        f"bs as materialized (select *, {sal} as sal from f)",
        f"cl as (select image_id, cluster, {means}, sum(n) as n, sum(sal) as s from bs join fin using (image_id, key) group by image_id, cluster)",
        f"h0 as materialized (select image_id, ord, f0, f1, f2, n from (select *, row_number() over (partition by image_id order by s desc, cluster) - 1 as ord from cl) where ord < {k})",
    ]
    for i in range(k):
        parts.append(
            f"h{i + 1} as materialized (select * from h{i} union all select image_id, ord, f0, f1, f2, n from (select b.image_id, b.key, any_value(b.f0) as f0, any_value(b.f1) as f1, any_value(b.f2) as f2, any_value(b.n) as n,"
            f" coalesce(min({d2}), 1e18)*any_value(sal) as score, count(c.ord) as ord from bs b left join h{i} c on b.image_id = c.image_id group by b.image_id, b.key)"
            f" where score > 0 and ord = {i} qualify row_number() over (partition by image_id order by score desc, key) = 1)"
        )
    rgb = o.oklab_bytes(f"(select *, f0/100 as nl, f1/100 as na, f2/100 as nb from h{k})")
    return ", " + ", ".join(parts) + f" select image_id, ord, r, g, b, cast(n as bigint) as n, {o.micro('n / sum(n) over (partition by image_id)')} as freq from {rgb}"


@query("c17_density_labels", _density_sql(_LABELS))
def density_labels(spark, sf):
    return cl.label_density(cl.salient_bins(valid(spark, sf))).select("image_id", "key", "c")


@query("c17_dbscan", _density_sql(_dbscan_sql()))
def dbscan(spark, sf):
    return shown(cl.dbscan(valid(spark, sf)))


def _merge_sql() -> str:
    """Up to seven merges of at most eight slots, one pair per palette and round."""
    parts = [f"m0 as materialized (select palette_id, ord as c, lab_l as f0, lab_a as f1, lab_b as f2, 1e0 as n from {o.lab('palettes')})"]
    for i in range(7):
        d2 = "+".join(f"(x.f{q}-y.f{q})*(x.f{q}-y.f{q})" for q in range(3))
        parts.append(
            f"t{i} as materialized (select x.palette_id, x.c as ci, y.c as cj, {', '.join(f'(x.f{q}*x.n+y.f{q}*y.n)/(x.n+y.n) as f{q}' for q in range(3))}, x.n+y.n as n from m{i} x join m{i} y"
            f" on x.palette_id = y.palette_id and x.c < y.c where {d2} < 1600e0 qualify row_number() over (partition by x.palette_id order by {d2}, x.c, y.c) = 1)"
        )
        parts.append(
            f"m{i + 1} as materialized (select m.* from m{i} m left join t{i} t on m.palette_id = t.palette_id and (m.c = ci or m.c = cj) where ci is null"
            f" union all select palette_id, ci, f0, f1, f2, n from t{i})"
        )
    cols = ", ".join(f"{o.micro(f'f{q}')} as f{q}" for q in range(3))
    return sql("palettes", ", " + ", ".join(parts) + f" select palette_id as image_id, row_number() over (partition by palette_id order by c) - 1 as c, {cols}, cast(n as bigint) as n from m7")


@query("c18_nearest_merge", _merge_sql())
def nearest_merge(spark, sf):
    """Palette slots of each palette merged in Lab until no pair is closer than 40."""
    slots = cl._featured(d.palettes(spark, sf).withColumn("image_id", F.col("palette_id")), "lab")
    slots = slots.select("image_id", F.col("ord").cast("bigint").alias("c"), *cl.FEATURES, F.lit(1.0).alias("n"), F.lit(0.0).alias("s"))
    out = cl.merge_clusters(slots, 40.0, 1)
    return out.select("image_id", "c", *[micro(f).alias(f) for f in cl.FEATURES], F.col("n").cast("bigint").alias("n"))


@query("c19_corpus_popularity", sql("pixels", f", px as (select 0 as corpus, * from pixels where a >= 1) {_popular('corpus', 8)}"))
def corpus_popularity(spark, sf):
    out = qz.popularity(valid(spark, sf).withColumn("corpus", F.lit(0)), k=8, group="corpus")
    return out.select("corpus", "ord", "r", "g", "b", "n", micro("freq").alias("freq"))


def _corpus_sql(px_: str, key: str, shown_key: str = "") -> str:
    points = f"select *, key as pos, n as w, ok_l*100 as f0, ok_a*100 as f1, ok_b*100 as f2 from {o.oklab(f'({_bins(5, key)})')}"
    means = ", ".join(f"sum(f{q}*n)/sum(n) as f{q}" for q in range(3))
    rgb = o.oklab_bytes(f"(select *, f0/100 as nl, f1/100 as na, f2/100 as nb from (select {key}, c, {means}, sum(n) as n from pt group by {key}, c))")
    tail = f" select {shown_key}row_number() over (partition by {key} order by n desc, c) - 1 as ord, r, g, b, n::bigint as n, {o.micro(f'n / sum(n) over (partition by {key})')} as freq from {rgb}"
    return sql("pixels", f", px as ({px_})" + _lloyd_sql(points, 5, SQL_ROUNDS, key) + tail)


@query("c19_corpus_kmeans", _corpus_sql("select 0 as corpus, * from pixels where a >= 1", "corpus"))
def corpus_kmeans(spark, sf):
    return cl.corpus_kmeans(valid(spark, sf)).select("ord", "r", "g", "b", "n", micro("freq").alias("freq"))


@query("c19_grouped_corpus_kmeans", _corpus_sql("select n_name as nation, pixels.* from pixels join supplier on image_id = s_suppkey join nation on s_nationkey = n_nationkey where a >= 1", "nation", "nation, "))
def grouped_corpus_kmeans(spark, sf):
    """A palette for the images of each nation's suppliers."""
    nation = d.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    of = d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image_id"), "s_nationkey").join(nation, "s_nationkey")
    return cl.corpus_kmeans(valid(spark, sf).join(of, "image_id"), group="nation").select("nation", "ord", "r", "g", "b", "n", micro("freq").alias("freq"))


@query(
    "a4_batch",
    sql(
        "pixels",
        f"""{_V}, pal as ({_popular()}), src as (select s_suppkey as image_id, s_suppkey as pos from supplier union all select s_suppkey + 1000000, s_suppkey + 1000000 from supplier where s_suppkey % 10 = 0)
 select image_id, pos, case when image_id not in (select image_id from images) then 'source not readable' when count(ord) = 0 then 'no pixels left after alpha mask' end as error,
  string_agg(printf('#%02x%02x%02x', r, g, b), ' ' order by ord) as hexes from src left join pal using (image_id) group by image_id, pos""",
    ),
)
def batch(spark, sf):
    s = d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image_id"))
    sources = s.unionByName(s.filter("image_id % 10 = 0").select((F.col("image_id") + 1000000).alias("image_id")))
    sources = sources.withColumn("pos", F.col("image_id"))
    rows = qz.batch(d.colours(spark, sf), sources, qz.popularity(valid(spark, sf)))
    hexes = F.array_join(F.transform("palette", lambda c: kernel.hex_text(c["r"], c["g"], c["b"])), " ")
    return rows.select("image_id", "pos", "error", hexes.alias("hexes"))


@query(
    "a4_extraction_job",
    sql(
        "pixels",
        f"""{_V}, pal as ({_popular()}), sh as (select image_id, idx, case when a=0 then 0 else r end as r, case when a=0 then 0 else g end as g, case when a=0 then 0 else b end as b from pixels),
 best as (select p.image_id, p.ord, s.idx from pal p join sh s on p.image_id = s.image_id
  qualify row_number() over (partition by p.image_id, p.ord order by (s.r-p.r)*(s.r-p.r)+(s.g-p.g)*(s.g-p.g)+(s.b-p.b)*(s.b-p.b), s.idx) = 1),
 t as (select image_id, count(*) as n_total, count(*) filter (where a >= 1) as n_valid from pixels group by image_id)
 select pal.image_id, row_number() over (partition by pal.image_id order by {o.hsl_l()} desc, ord) - 1 as ord, r, g, b, {o.micro('(idx % w + 0.5)/w')} as src_x, {o.micro('(idx // w + 0.5)/h')} as src_y,
  'popularity' as method, 'palette_size=5,reverse=True,sort_by=lightness' as params, t.n_total, t.n_valid from pal join best using (image_id, ord) join images using (image_id) join t on t.image_id = pal.image_id""",
    ),
)
def extraction_job(spark, sf):
    palette, record = ex.extract(d.pixels(spark, sf), d.images(spark, sf), "popularity", sort_by="lightness", reverse=True, located=True)
    pairs = F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    record = record.select("image_id", "method", F.array_join(pairs, ",").alias("params"), "n_total", "n_valid")
    return palette.select("image_id", "ord", "r", "g", "b", micro("src_x").alias("src_x"), micro("src_y").alias("src_y")).join(record, "image_id")


# --- job tables ---------------------------------------------------------------------------------------------------------

_PRESETS = list(K.MOOD_PRESETS)
# a preset and, for some images, an own bound for each pair of image and number
_MOOD_JOBS = f"""select s_suppkey * 10 + p as job, s_suppkey as image_id, p, case when s_suppkey % 4 = 1 then 0.5 end as min_l, cast(10 + s_suppkey % 50 as int) as k from supplier"""
_RULES_SQL = "rules(p, l0, l1, c0, c1) as (values " + ", ".join(f"({i}, {a}, {b}, {c}, {e})" for i, (a, b, c, e, *_) in enumerate(K.MOOD_PRESETS.values())) + ")"


def _jobs(spark, sf, n: int):
    """Rows (s_suppkey, p) for p below n."""
    p = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("p")
    return d.table(spark, sf, "supplier").select("s_suppkey", p)


@query(
    "c11_mood_jobs",
    sql(
        "pixels",
        f"""{_V}, {_RULES_SQL}, jobs as ({_MOOD_JOBS.replace("from supplier", "from supplier, range(6) as t(p)")}), c as (select * from {o.oklab('(select image_id, r, g, b, count(*) as n from px group by all)')}),
 m as (select job, k, r, g, b, n, ok_l >= coalesce(min_l, l0) and ok_l <= l1 and ok_c >= c0 and (c1 <= 0 or ok_c <= c1) as hit from jobs join rules using (p) join c using (image_id)),
 t as (select job, case when sum(case when hit then n else 0 end) < k then 1 else 0 end as f, sum(case when hit then n else 0 end) as hits, sum(n) as every from m group by job, k)
 select job, f = 1 as fell_back, cast(case when f = 1 then every else hits end as bigint) as n_kept, count(*) as n_colours, cast(sum(r * 65536 + g * 256 + b) as bigint) as colours from m join t using (job) where hit or f = 1 group by 1, 2, 3""",
    ),
)
def mood_jobs(spark, sf):
    """Six presets for every image in one pass, some with an own bound."""
    name = F.element_at(F.array(*map(F.lit, _PRESETS)), F.col("p") + 1).alias("preset")
    knobs = [F.lit(None).cast("double").alias(x) for x in jb.KNOBS if x != "min_l"]
    jobs = _jobs(spark, sf, 6).selectExpr("s_suppkey * 10 + p as unit", "s_suppkey as image_id", "p", "case when s_suppkey % 4 = 1 then 0.5D end as min_l", "cast(10 + s_suppkey % 50 as int) as k")
    kept = jb.mood_colours(px.color_counts(valid(spark, sf)), jb.with_rules(jobs.select("unit", "image_id", "k", "min_l", name, *knobs)))
    colour = F.col("r").cast("bigint") * 65536 + F.col("g") * 256 + F.col("b")
    return kept.groupBy(F.col("unit").alias("job"), "fell_back", "n_kept").agg(F.count("*").alias("n_colours"), F.sum(colour).alias("colours"))


@query(
    "a4_job_table",
    sql(
        "pixels",
        f"""{_V}, bins as ({_bins(5)}), best as (select *, row_number() over (partition by image_id order by n desc, key) - 1 as ord from bins),
 jobs as (select s_suppkey * 10 + p as job, s_suppkey as image_id, case when (s_suppkey + p) % 20 = 0 then 'magic' else 'popularity' end as method, (s_suppkey * 7 + p * 5) % 34 as k from supplier, range(4) as t(p)),
 bad as (select job, image_id, case when method = 'magic' then 'unknown method magic' when not k between 1 and 32 then 'a palette has 1 to 32 colours, not ' || k when image_id not in (select image_id from px) then 'no pixels' end as error, k from jobs)
 select job, cast(ord as int) as ord, r, g, b, n, {o.micro('n / sum(n) over (partition by job)')} as freq, null as error from bad join best using (image_id) where error is null and ord < k
 union all select job, null, null, null, null, null, null, error from bad where error is not null""",
    ),
)
def job_table(spark, sf):
    """Four popularity jobs an image, with a number of colours a row; jobs that cannot run keep a row."""
    jobs = _jobs(spark, sf, 4).selectExpr("s_suppkey * 10 + p as job", "s_suppkey as image_id", "if((s_suppkey + p) % 20 = 0, 'magic', 'popularity') as method", "cast((s_suppkey * 7 + p * 5) % 34 as int) as k")
    palettes, records = jb.run_jobs(d.colours(spark, sf), jobs)
    rows = palettes.select("job", "ord", "r", "g", "b", "n", micro("freq").alias("freq"), F.lit(None).cast("string").alias("error"))
    return rows.unionByName(records.filter("error is not null").select("job", "error"), allowMissingColumns=True)


@query("a4_mixed_jobs")
def mixed_jobs(spark, sf):
    """A job an image with one of four methods, three to six colours and, for the soft methods, one of six presets.
    Tested against single extractions; as SQL it is the four methods' queries with a number of clusters a row."""
    method = "element_at(array('soft', 'softk', 'okkmeans', 'wkmeans'), cast(s_suppkey % 4 as int) + 1)"
    name = "element_at(array(" + ", ".join(f"'{x}'" for x in _PRESETS) + "), cast(s_suppkey % 6 as int) + 1)"
    jobs = _jobs(spark, sf, 1).selectExpr("s_suppkey as job", "s_suppkey as image_id", f"{method} as method", "cast(3 + s_suppkey % 4 as int) as k", f"if(s_suppkey % 4 < 2, {name}, null) as preset")
    palettes, _ = jb.run_jobs(d.colours(spark, sf), jobs)
    return palettes.select("job", "ord", "r", "g", "b", "n", micro("freq").alias("freq"), "fell_back")
