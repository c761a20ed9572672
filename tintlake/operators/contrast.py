"""Contrast audits over pair tables, roll-ups, the lightness-fix search, colour-vision simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import contrast as score
from ..functions import kernel
from ..functions.parse import with_parsed

FG, BG = ("fr", "fg", "fb"), ("br", "bg", "bb")
WCAG_TARGET, APCA_TARGET = 4.5, 60.0
SAMPLES, L_MIN, L_MAX = 64, 0.03, 0.99


def _cols(names: tuple[str, ...]) -> tuple[Column, ...]:
    return tuple(F.col(n) for n in names)


def audit_wcag(pairs: DataFrame) -> DataFrame:
    """Add ``ratio`` (two decimals) and the four flags read from the rounded ratio."""
    df = kernel.staged(pairs, {"_fl": kernel.luminance(*_cols(FG)), "_bl": kernel.luminance(*_cols(BG))})
    df = df.withColumn("ratio", score.ratio(F.col("_fl"), F.col("_bl"))).drop("_fl", "_bl")
    r = F.col("ratio")
    return df.withColumns({"aa": r >= 4.5, "aa_large": r >= 3, "aaa": r >= 7, "aaa_large": r >= 4.5})


def audit_apca(pairs: DataFrame) -> DataFrame:
    """Add signed ``lc`` and ``abs_lc`` (two decimals); the flags read the unrounded magnitude."""
    df = _with_lc(pairs, FG, "_lc")
    size = F.abs("_lc")
    flags = {"body_text": size >= 75, "content": size >= 60, "large_heading": size >= 45, "icon": size >= 30}
    return df.withColumns({"lc": score.two_decimals(F.col("_lc")), "abs_lc": score.two_decimals(size), **flags}).drop("_lc")


def _with_lc(pairs: DataFrame, fg: tuple[str, ...], out: str) -> DataFrame:
    """Unrounded APCA score of ``fg`` over the background columns."""
    return kernel.staged(
        pairs,
        {"_ty": score.screen_light(*_cols(fg)), "_by": score.screen_light(*_cols(BG))},
        {"_ty": score.soft_black(F.col("_ty")), "_by": score.soft_black(F.col("_by"))},
        {out: score.apca_from_light(F.col("_ty"), F.col("_by"))},
        drop=("_ty", "_by"),
    )


def audit(pairs: DataFrame, algo: str = "wcag21") -> DataFrame:
    if algo in ("", "wcag21"):
        return audit_wcag(pairs)
    if algo == "apca":
        return audit_apca(pairs)
    if algo == "both":
        return audit_apca(audit_wcag(pairs))
    raise ValueError(f"unknown algo {algo!r}")


def audit_pair_lists(lists: DataFrame, text: str = "pairs") -> DataFrame:
    """Audit comma-separated ``fg:bg`` lists, any colour notation without commas on either side.

    Each entry becomes a row (pos, fg, bg); a side that does not parse leaves the flags null and an error.
    """
    entries = lists.select("*", F.posexplode(F.split(F.col(text), ",")).alias("pos", "_entry")).drop(text)
    entries = entries.withColumns(
        {"fg_text": F.trim(F.substring_index("_entry", ":", 1)), "bg_text": F.trim(F.regexp_extract("_entry", r"^[^:]*:(.*)$", 1))}
    ).drop("_entry")
    names = dict(zip("rgb", FG))
    df = with_parsed(entries, "fg_text").withColumnsRenamed({**names, "error": "fg_error"}).drop("a", "notation")
    names = dict(zip("rgb", BG))
    df = with_parsed(df, "bg_text").withColumnsRenamed({**names, "error": "bg_error"}).drop("a", "notation")
    df = df.withColumn("error", F.coalesce("fg_error", "bg_error")).drop("fg_error", "bg_error")
    return audit_wcag(df)


def audit_summary(audited: DataFrame, *levels: str) -> DataFrame:
    """Pairs passing AA, AAA and both, and urgent ones (AA-large fails), rolled up over ``levels``."""
    return audited.rollup(*levels).agg(
        F.count("*").alias("n_pairs"),
        F.count_if("aa").alias("n_aa"),
        F.count_if("aaa").alias("n_aaa"),
        F.count_if(F.col("aa") & F.col("aaa")).alias("n_both"),
        F.count_if(~F.col("aa_large")).alias("n_urgent"),
    )


def _ladder_l(i: Column) -> Column:
    return kernel.lit(L_MIN) + kernel.lit(L_MAX - L_MIN) * i / float(SAMPLES - 1)


def _goal(algo: str, target: float | None) -> float:
    if algo not in ("wcag21", "apca"):
        raise ValueError(f"no fix search for algo {algo!r}")
    goal = target if target is not None else (WCAG_TARGET if algo == "wcag21" else APCA_TARGET)
    if goal <= 0:
        raise ValueError("target must be above 0")
    return goal


def _score_at(df: DataFrame, algo: str) -> DataFrame:
    """Add the candidate at lightness step ``i`` (l, r, g, b) and its score; needs the foreground's OkLCH."""
    df = df.withColumn("l", _ladder_l(F.col("i")))
    df = kernel.with_oklch_bytes(df, F.col("l"), F.col("ok_c"), F.col("ok_h"))
    if algo == "apca":
        return _with_lc(df, ("r", "g", "b"), "_lc").withColumn("score", score.two_decimals(F.abs("_lc"))).drop("_lc")
    return kernel.staged(
        df,
        {"_fl": kernel.luminance(*_cols(("r", "g", "b"))), "_bl": kernel.luminance(*_cols(BG))},
        {"score": score.ratio(F.col("_fl"), F.col("_bl"))},
        drop=("_fl", "_bl"),
    )


def _sampled(pairs: DataFrame, key: str, algo: str, goal: float) -> DataFrame:
    df = kernel.with_oklch(pairs.select(key, *FG, *BG), *FG).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))))
    return _score_at(df, algo).withColumns({"passes": F.col("score") >= goal, "distance": F.abs(F.col("l") - F.col("ok_l"))})


def lightness_samples(pairs: DataFrame, key: str, algo: str = "wcag21", target: float | None = None) -> DataFrame:
    """64 OkLCH lightness variants of every foreground, scored against its background.

    Chroma and hue stay; candidates are clamped to sRGB.
    """
    return _sampled(pairs, key, algo, _goal(algo, target)).select(key, "i", "l", "r", "g", "b", "score", "passes", "distance")


def suggest_lightness(pairs: DataFrame, key: str, algo: str = "wcag21", target: float | None = None) -> DataFrame:
    """Passing sample nearest the original lightness, first on ties; nulls when none passes.

    Distance and step share one integer, so the pick is a hash aggregate that collapses each pair's samples
    before the shuffle; only the winner is scored again.
    """
    samples = _sampled(pairs, key, algo, _goal(algo, target))
    packed = F.floor(F.col("distance") * float(1 << 50)).cast("bigint") * SAMPLES + F.col("i")
    best = samples.groupBy(key, *FG, *BG).agg(F.count_if("passes").alias("n_passing"), F.min(F.when(F.col("passes"), packed)).alias("_best"))
    best = best.withColumn("i", (F.col("_best") % SAMPLES).cast("int"))
    found = F.col("i").isNotNull()
    out = _score_at(kernel.with_oklch(best, *FG), algo)
    return out.select(key, "n_passing", "i", *[F.when(found, F.col(c)).alias(c) for c in ("l", "r", "g", "b", "score")])


def _seen(kind: str, channels: list[str] | str) -> list[Column]:
    """Three channels under a deficiency. Matrices are integers in thousandths, so rounding is exact."""
    return [
        F.least(F.floor((sum((F.col(c) * w for c, w in zip(channels, row)), F.lit(0)) + 500) / 1000), F.lit(255)).cast("int").alias(c)
        for c, row in zip(channels, K.CVD_MATRICES[kind])
    ]


def simulate_pairs(pairs: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Both colours of each pair under each deficiency, in one projection."""
    rows = [F.struct(F.lit(kind).alias("kind"), *_seen(kind, FG), *_seen(kind, BG)) for kind in kinds or K.CVD_KINDS]
    return pairs.select(*[c for c in pairs.columns if c not in (*FG, *BG)], F.inline(F.array(*rows)))


def simulate_vision(colors: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Each colour under each deficiency, alpha kept."""
    rows = [F.struct(F.lit(kind).alias("kind"), *_seen(kind, "rgb")) for kind in kinds or K.CVD_KINDS]
    keep = [c for c in colors.columns if c not in ("r", "g", "b")]
    return colors.select(*keep, F.inline(F.array(*rows)))
