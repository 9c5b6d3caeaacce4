"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    """``value`` limited to [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def in_year(date: Column, year: str) -> Column:
    """Whether a date string starts with a year."""
    return F.substring(date, 1, 4) == year


def round_half_up(value: Column, digits: int = 1) -> Column:
    """Rounding of ties upwards on the scaled value, as an alternative to ``round``."""
    scale = 10**digits
    return F.floor(value * scale + 0.5) / scale


def leave_one_out(total: Column, count: Column, own: Column) -> Column:
    """Mean without the own value (null: nothing to leave out); 0 if nothing is left."""
    left = count - F.when(own.isNotNull(), 1).otherwise(0)
    return F.coalesce(F.try_divide(total - F.coalesce(own, F.lit(0.0)), left), F.lit(0.0))


def moments(x: Column, y: Column) -> list[Column]:
    """Aggregates ``vx, vy, cov``: centred moments that are merged as means and deviations, so a large mean costs no digits.

    A constant side has a variance of exactly 0, whatever merging leaves.
    """
    spread = lambda v: F.when(F.min(v) < F.max(v), F.var_pop(v)).otherwise(0.0)
    return [spread(x).alias("vx"), spread(y).alias("vy"), F.covar_pop(x, y).alias("cov")]


def pearson(n: Column, vx: Column, vy: Column, cov: Column) -> Column:
    """Pearson correlation from centred moments; 0 where it is undefined.

    Twelve digits are kept: what merging leaves of a covariance of 0 must not
    count as a weight.
    """
    defined = (n >= 2) & (vx > 0) & (vy > 0)
    return F.when(defined, F.round(F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)), 12)).otherwise(F.lit(0.0))
