"""SQL fragments for the oracle side, written from the published formulas."""

from __future__ import annotations

from ..functions import constants as K


def lin(c: str) -> str:
    return f"(case when {c} <= 10 then {c}/255e0/12.92e0 else pow(({c}/255e0+0.055e0)/1.055e0, 2.4e0) end)"


def gam(v: str) -> str:
    return f"(case when {v} <= 0.0031308e0 then {v}*12.92e0 else 1.055e0*pow(greatest({v},0e0), 1e0/2.4e0)-0.055e0 end)"


def byte(v: str) -> str:
    return f"cast(floor(least(greatest({v},0e0),1e0)*255e0+0.5e0) as int)"


def num(v: float) -> str:
    return f"({float(v)!r}::double)"


def mix(weights, cols) -> str:
    return "(" + " + ".join(f"{num(w)}*{c}" for w, c in zip(weights, cols)) + ")"


def oklab(src: str, r="r", g="g", b="b", p="ok_") -> str:
    """Sub-select adding {p}l {p}a {p}b {p}c {p}h."""
    q1 = f"select *, {lin(r)} as _lr, {lin(g)} as _lg, {lin(b)} as _lb from {src}"
    roots = ", ".join(f"cbrt({mix(w, ['_lr', '_lg', '_lb'])}) as _c{i}" for i, w in enumerate(K.OKLAB_LMS))
    q2 = f"select * exclude (_lr, _lg, _lb), {roots} from ({q1})"
    labs = ", ".join(f"{mix(w, ['_c0', '_c1', '_c2'])} as {p}{n}" for n, w in zip("lab", K.OKLAB_FROM_LMS))
    q3 = f"select * exclude (_c0, _c1, _c2), {labs} from ({q2})"
    return f"(select *, sqrt({p}a*{p}a+{p}b*{p}b) as {p}c, {wrap(f'degrees(atan2({p}b, {p}a))')} as {p}h from ({q3}))"


def wrap(v: str) -> str:
    return f"(({v}) - 360e0*floor(({v})/360e0))"


def oklab_bytes(src: str, L="nl", a="na", b="nb", out=("r", "g", "b"), drop: str = "") -> str:
    """Sub-select adding byte channels for OkLab columns."""
    roots = ", ".join(f"pow({L} + {num(wa)}*{a} + {num(wb)}*{b}, 3) as _q{i}" for i, (wa, wb) in enumerate(K.OKLAB_TO_LMS))
    lins = ", ".join(f"{mix(w, ['_q0', '_q1', '_q2'])} as _v{i}" for i, w in enumerate(K.OKLAB_LMS_TO_RGB))
    outs = ", ".join(f"{byte(gam(f'_v{i}'))} as {o}" for i, o in enumerate(out))
    gone = "_q0,_q1,_q2,_v0,_v1,_v2" + ("," + drop if drop else "")
    return f"(select * exclude ({gone}), {outs} from (select *, {lins} from (select *, {roots} from {src})))"


def lum(r: str, g: str, b: str) -> str:
    return f"(0.2126e0*{lin(r)}+0.7152e0*{lin(g)}+0.0722e0*{lin(b)})"


def hue(r="r", g="g", b="b") -> str:
    hi, lo = f"greatest({r},{g},{b})", f"least({r},{g},{b})"
    d = f"({hi}-{lo})::double"
    s = (
        f"(case when {hi}={lo} then 0e0 when {hi}={r} then ({g}-{b})/{d} when {hi}={g} then 2e0+({b}-{r})/{d}"
        f" else 4e0+({r}-{g})/{d} end)*60e0"
    )
    return f"(case when {s} < 0 then {s}+360e0 else {s} end)"


def hsl_l(r="r", g="g", b="b") -> str:
    return f"((greatest({r},{g},{b})+least({r},{g},{b}))/510e0)"


def hsl_s(r="r", g="g", b="b") -> str:
    hi, lo = f"greatest({r},{g},{b})", f"least({r},{g},{b})"
    return f"(case when {hi}={lo} then 0e0 when {hi}+{lo} < 255 then ({hi}-{lo})/({hi}+{lo})::double else ({hi}-{lo})/(510e0-{hi}-{lo}) end)"


def hsv_s(r="r", g="g", b="b") -> str:
    hi, lo = f"greatest({r},{g},{b})", f"least({r},{g},{b})"
    return f"(case when {hi}=0 then 0e0 else ({hi}-{lo})/{hi}::double end)"


def hsv_v(r="r", g="g", b="b") -> str:
    return f"(greatest({r},{g},{b})/255e0)"


def hsl_channel(h: str, s: str, l: str, n: int) -> str:
    k = f"(fmod({wrap(h)}/30e0+{n}e0, 12e0))"
    return byte(f"({l} - {s}*least({l},1e0-{l})*greatest(-1e0, least({k}-3e0, 9e0-{k}, 1e0)))")


def hsv_channel(h: str, s: str, v: str, n: int) -> str:
    k = f"(fmod({wrap(h)}/60e0+{n}e0, 6e0))"
    return byte(f"({v} - {v}*{s}*greatest(0e0, least({k}, 4e0-{k}, 1e0)))")


def from_hsl(h: str, s: str, l: str) -> str:
    return ", ".join(f"{hsl_channel(h, s, l, n)} as {c}" for c, n in zip("rgb", (0, 8, 4)))


def from_hsv(h: str, s: str, v: str) -> str:
    return ", ".join(f"{hsv_channel(h, s, v, n)} as {c}" for c, n in zip("rgb", (5, 3, 1)))


def lab(src: str, r="r", g="g", b="b", p="lab_") -> str:
    q1 = f"select *, {lin(r)} as _lr, {lin(g)} as _lg, {lin(b)} as _lb from {src}"
    xyz = ", ".join(f"{mix(w, ['_lr', '_lg', '_lb'])}/{num(d)} as _x{i}" for i, (w, d) in enumerate(zip(K.RGB_TO_XYZ, K.D65)))
    q2 = f"select * exclude (_lr,_lg,_lb), {xyz} from ({q1})"
    f = ", ".join(
        f"(case when _x{i} > pow(6e0/29e0,3) then cbrt(_x{i}) else _x{i}/3e0*pow(29e0/6e0,2)+4e0/29e0 end) as _f{i}" for i in range(3)
    )
    q3 = f"select * exclude (_x0,_x1,_x2), {f} from ({q2})"
    return f"(select * exclude (_f0,_f1,_f2), _f1*116e0-16e0 as {p}l, (_f0-_f1)*500e0 as {p}a, (_f1-_f2)*200e0 as {p}b from ({q3}))"


def lab_bytes(src: str, L="nl", a="na", b="nb", out=("r", "g", "b"), drop: str = "") -> str:
    fy = f"(({L}+16e0)/116e0)"
    fs = [f"({fy}+{a}/500e0)", fy, f"({fy}-{b}/200e0)"]
    inv = ", ".join(
        f"{num(d)}*(case when {f} > 6e0/29e0 then pow({f},3) else ({f}-4e0/29e0)*3e0*pow(6e0/29e0,2) end) as _x{i}"
        for i, (f, d) in enumerate(zip(fs, K.D65))
    )
    lins = ", ".join(f"{mix(w, ['_x0', '_x1', '_x2'])} as _v{i}" for i, w in enumerate(K.XYZ_TO_RGB))
    outs = ", ".join(f"{byte(gam(f'_v{i}'))} as {o}" for i, o in enumerate(out))
    gone = "_x0,_x1,_x2,_v0,_v1,_v2" + ("," + drop if drop else "")
    return f"(select * exclude ({gone}), {outs} from (select *, {lins} from (select *, {inv} from {src})))"


def ryb_to_rgb(h: str) -> str:
    """``h`` must be a column already in [0, 360)."""
    seg = f"({h}/15e0)"
    arr = "[" + ",".join(f"{v}e0" for v in K.RYB_RGB_HUES) + "]"
    i = f"cast(floor({seg}) as int)"
    return f"({arr}[{i}+1] + ({arr}[{i}+2]-{arr}[{i}+1])*({seg}-floor({seg})))"


def rgb_to_ryb(h: str) -> str:
    """``h`` must be a column already in [0, 360)."""
    hs = K.RYB_RGB_HUES
    w = h
    return "(case " + " ".join(
        f"when {w} < {hi} then ({i}e0+({w}-{lo}e0)/{hi - lo}e0)*15e0" for i, (lo, hi) in enumerate(zip(hs, hs[1:]))
    ) + " end)"


def micro(v: str) -> str:
    """Float scaled to 1e-6 and rounded, as BIGINT."""
    return f"cast(floor(({v})*1e6+0.5) as bigint)"


def wcag(fr: str, br: str) -> str:
    """WCAG ratio from two luminance columns."""
    return f"(floor((greatest({fr},{br})+0.05e0)/(least({fr},{br})+0.05e0)*100e0+0.5e0)/100e0)"


def apca_y(r: str, g: str, b: str) -> str:
    y = "(" + "+".join(f"{num(w)}*pow({c}/255e0,2.4e0)" for w, c in zip(K.APCA_LUMA, (r, g, b))) + ")"
    return f"(case when {y} < 0.022e0 then {y}+pow(0.022e0-{y},1.414e0) else {y} end)"


def apca(t: str, k: str) -> str:
    dark = f"((pow({k},0.56e0)-pow({t},0.57e0))*1.14e0)"
    light = f"((pow({k},0.65e0)-pow({t},0.62e0))*1.14e0)"
    return (
        f"(case when abs({k}-{t}) < 0.0005e0 then 0e0 when {k} > {t} then (case when {dark} < 0.1e0 then 0e0 else ({dark}-0.027e0)*100e0 end)"
        f" else (case when {light} > -0.1e0 then 0e0 else ({light}+0.027e0)*100e0 end) end)"
    )
