"""Numbers of curves and names of turns, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least radius in metres for a curve's number; turns below are straight (degrees).
RADIUS_OF_NUMBER = ((220, 6), (140, 5), (85, 4), (50, 3), (28, 2))
MIN_TURN_DEG = 15.0


def curve_number(degrees: Column, meters: Column) -> Column:
    """1 (hairpin) to 6 (fast) of a curve that turns by `degrees` over `meters`; null for less than a turn.

    The radius leads; wide sweeps stay fast, short and sharp corners become tighter, a hairpin needs both angle and
    radius, and slight bends are never tight."""
    radius = meters / F.greatest(F.radians(degrees), F.lit(0.08))
    (least, number), *rest = RADIUS_OF_NUMBER
    n = reduce(lambda acc, r: acc.when(radius >= r[0], r[1]), rest, F.when(radius >= least, number)).otherwise(1)
    n = F.when((degrees >= 75) & (radius >= 240), 6).when((degrees >= 75) & (radius >= 160), F.greatest(n, F.lit(5))).otherwise(n)
    n = F.when((degrees >= 70) & (meters < 45) & (radius < 32), F.least(n, F.lit(2))).when((degrees >= 55) & (meters < 55) & (radius < 45), F.least(n, F.lit(3))).otherwise(n)
    n = F.when(n == 1, F.when((degrees >= 120) & (radius < 36), 1).otherwise(2)).when((degrees >= 140) & (radius < 28), 1).otherwise(n)
    n = F.when((degrees < 35) & (n <= 3), 6).otherwise(n)
    return F.when((degrees >= MIN_TURN_DEG) & (meters > 0), n)


def severity(number: Column) -> Column:
    return F.when(number <= 2, "tight").when(number <= 4, "normal").when(number.isNotNull(), "fast")


def junction_side(delta: Column) -> Column:
    """right, left or straight, by the signed change of bearing."""
    return F.when(F.coalesce(F.abs(delta) < MIN_TURN_DEG, F.lit(True)), "straight").when(delta > 0, "right").otherwise("left")
