"""Plane geometry and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Col, col

# ── fixed values ────────────────────────────────────────────────────────────
EMU_PER_INCH = 914400
MM_PER_POINT = 0.352778
MIN_CROP = 20
# ────────────────────────────────────────────────────────────────────────────


def half_up(c: Col) -> Column:
    """Round halves toward positive infinity."""
    return F.floor(col(c) + 0.5)


def rect_of(ax: Col, ay: Col, bx: Col, by: Col) -> dict[str, Column]:
    """The rectangle spanned by two corners given in any order."""
    return {
        "x": F.least(col(ax), col(bx)), "y": F.least(col(ay), col(by)),
        "w": F.abs(col(bx) - col(ax)), "h": F.abs(col(by) - col(ay)),
    }


def crop_clamp(x: Col, y: Col, w: Col, h: Col, width: Col, height: Col) -> dict[str, Column]:
    """A crop box held inside its page and never thinner than the minimum."""
    left = F.greatest(F.lit(0), F.least(col(x), col(width)))
    top = F.greatest(F.lit(0), F.least(col(y), col(height)))
    return {
        "x": left, "y": top,
        "w": F.greatest(F.lit(MIN_CROP), F.least(col(w), col(width) - left)),
        "h": F.greatest(F.lit(MIN_CROP), F.least(col(h), col(height) - top)),
    }


def twips_to_points(c: Col) -> Column:
    return col(c).try_cast("double") / 20


def half_points_to_points(c: Col) -> Column:
    return col(c).try_cast("double") / 2


def pixels_to_emu(c: Col) -> Column:
    return col(c) * (EMU_PER_INCH // 96)


def points_to_mm(c: Col) -> Column:
    return half_up(col(c) * MM_PER_POINT)


def affine_apply(m: list[Col], x: Col, y: Col) -> tuple[Column, Column]:
    a, b, c, d, e, f = (col(v) for v in m)
    return a * col(x) + c * col(y) + e, b * col(x) + d * col(y) + f


def affine_multiply(outer: list[Col], inner: list[Col]) -> list[Column]:
    """``outer`` applied after ``inner``."""
    a, b, c, d, e, f = (col(v) for v in outer)
    p, q, r, s, t, u = (col(v) for v in inner)
    return [a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s,
            a * t + c * u + e, b * t + d * u + f]


def affine_rotation(m: list[Col]) -> Column:
    return F.atan2(col(m[1]), col(m[0]))


def affine_scale(m: list[Col]) -> Column:
    a, b, c, d = (col(v) for v in m[:4])
    scale = F.sqrt(F.abs(a * d - b * c))
    return F.when(scale == 0, 1.0).otherwise(scale)
