"""WCAG 2.1 and APCA scores as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .kernel import dot, lit

BLACK_LEVEL, BLACK_POWER = 0.022, 1.414


def ratio(one: Column, two: Column) -> Column:
    """Luminance ratio already rounded to two decimals; null when either side is missing."""
    known = one.isNotNull() & two.isNotNull()
    return F.when(known, F.floor((F.greatest(one, two) + 0.05) / (F.least(one, two) + 0.05) * 100.0 + 0.5) / 100.0)


_POWERS = "array(" + ",".join(f"{(i / 255) ** 2.4!r}D" for i in range(256)) + ")"


def screen_light(r: Column, g: Column, b: Column) -> Column:
    """APCA screen luminance, powers from a 256-entry literal array."""
    powers = F.expr(_POWERS)
    return dot(K.APCA_LUMA, [F.get(powers, c.cast("int")) for c in (r, g, b)])


def soft_black(y: Column) -> Column:
    return F.when(y < BLACK_LEVEL, y + F.pow(lit(BLACK_LEVEL) - y, lit(BLACK_POWER))).otherwise(y)


def apca_from_light(text: Column, back: Column) -> Column:
    """Signed Lc: positive for dark text on a light ground."""
    dark = (F.pow(back, lit(0.56)) - F.pow(text, lit(0.57))) * 1.14
    light = (F.pow(back, lit(0.65)) - F.pow(text, lit(0.62))) * 1.14
    return (
        F.when(F.abs(back - text) < 0.0005, lit(0))
        .when(back > text, F.when(dark < 0.1, lit(0)).otherwise((dark - 0.027) * 100.0))
        .otherwise(F.when(light > -0.1, lit(0)).otherwise((light + 0.027) * 100.0))
    )


def two_decimals(v: Column) -> Column:
    return F.signum(v) * F.floor(F.abs(v) * 100.0 + 0.5) / 100.0
