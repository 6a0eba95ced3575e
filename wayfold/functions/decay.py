"""Distance decay, detour budgets and path penalties, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN99 = math.log(99)


def exponential(d: Column, beta: float, plateau: float = 0.0) -> Column:
    """1 up to the plateau, then exponential decay."""
    return F.exp(-beta * F.greatest(d - plateau, F.lit(0.0)))


def logistic_gravity(d: Column, slope: float, midpoint: float, plateau: float = 0.0) -> Column:
    """The accessibility form: the plateau shifts the curve and is not clamped."""
    return 1 - 1 / (1 + F.exp(-slope * (d - plateau - midpoint)))


def logistic(d: Column, slope: float, midpoint: float) -> Column:
    return 1 / (1 + F.exp(slope * (d - midpoint)))


def radius_logistic(d: Column, radius: float) -> Column:
    """The flow form over a whole radius: its midpoint is half of it."""
    return logistic(d, LN99 / max(radius, 1.0), radius / 2)


def detour_penalty(excess: Column, curve: str, beta: float, midpoint: float) -> Column:
    """Weight of a via-arc by its excess over the shortest path; 0.5 at no excess in the logistic form."""
    if curve == "equal":
        return F.lit(1.0)
    if curve == "exponential":
        return F.when(excess <= 0, 1.0).otherwise(F.exp(-beta * excess))
    return 1 / (1 + F.exp(LN99 / midpoint * excess))


def route_penalty(excess: Column, curve: str, beta: float, midpoint: float) -> Column:
    """Weight of an enumerated route by its excess."""
    x = F.greatest(excess, F.lit(0.0))
    if curve == "equal":
        return F.lit(1.0)
    return F.exp(-beta * x) if curve == "exponential" else 1 / (1 + F.exp(beta * (x - midpoint)))


def detour_budget(shortest: Column, mode: str, ratio: float, buffer: float) -> Column:
    """The longest admissible route."""
    by_ratio, by_buffer = shortest * ratio, shortest + buffer
    return {"ratio": by_ratio, "buffer": by_buffer, "min": F.least(by_ratio, by_buffer)}[mode]


def cost_tolerance(shortest: Column) -> Column:
    return F.greatest(F.lit(1e-4), F.abs(shortest) * 1e-5)


def minutes(distance: Column, km_per_hour: float) -> Column:
    return distance / (km_per_hour * 1000 / 60)
