"""Planar geometry over columns; a line is an array of structs of x and y (and z)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_length(coords: str) -> Column:
    """Length in the plane of a line of points."""
    return F.expr(
        f"aggregate(zip_with(slice({coords}, 1, greatest(size({coords}) - 1, 0)), slice({coords}, 2, size({coords})), "
        "(a, b) -> hypot(b.x - a.x, b.y - a.y)), 0D, (s, d) -> s + d)"
    )


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees from the x axis, in (-180, 180]."""
    return F.degrees(F.atan2(y2 - y1, x2 - x1))


def north_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(x2 - x1, y2 - y1)) + 360, F.lit(360.0))


def via_angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Absolute deviation in degrees from going straight on at b, from a to c, of the rounded turn."""
    turn = bearing(bx, by, cx, cy) - bearing(bx, by, ax, ay)
    return F.abs(F.abs(F.bround(turn)) - 180)


def straightness(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Cosine of the change of direction at b: 1 straight on, -1 back."""
    x1, y1, x2, y2 = bx - ax, by - ay, cx - bx, cy - by
    return (x1 * x2 + y1 * y2) / (F.hypot(x1, y1) * F.hypot(x2, y2))


def project(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """(share of the segment at the nearest point, squared distance to it)."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square > 0, ((px - x1) * dx + (py - y1) * dy) / square).otherwise(0.0)
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return t, ex * ex + ey * ey
