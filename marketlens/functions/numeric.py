"""Null-safe numbers, ratios, rounding, intervals and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str, minimum: float | None = None) -> Column:
    """True for a present, non-NaN, finite number; never null."""
    x = col(c).cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(ok & (x >= minimum) if minimum is not None else ok, F.lit(False))


def number(c: Column | str, default: float = 0.0) -> Column:
    """Text as a double; the default where it does not parse."""
    return F.coalesce(col(c).try_cast("double"), F.lit(default))


def between(c: Column | str, low: float, high: float) -> Column:
    return col(c).between(low, high)


def ratio(a: Column, b: Column) -> Column:
    """``a / max(1, b)``."""
    return a / F.greatest(F.lit(1.0), b.cast("double"))


def pct_change(new: Column, old: Column) -> Column:
    return (new / F.nullif(old, F.lit(0.0)) - 1) * 100


def log_distance(a: Column, b: Column) -> Column:
    ok = (a > 0) & (b > 0)
    return F.when(ok, F.abs(F.ln(F.when(ok, a) / F.when(ok, b))))


def log10_distance(a: Column, b: Column) -> Column:
    ok = (a > 0) & (b > 0)
    return F.when(ok, F.abs(F.log10(F.when(ok, a) / F.when(ok, b))))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.lit(40.0), F.greatest(F.lit(-40.0), z))))


def half_even(c: Column | str, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def wilson(events: Column, n: Column) -> tuple[Column, Column, Column]:
    """Rate and 95 % Wilson bounds, clamped to 0..1; null without observations."""
    z = 1.959963984540054
    m = F.when(n > 0, n.cast("double"))
    p = events / m
    den = 1 + z * z / m
    center = (p + z * z / (2 * m)) / den
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / den
    return (p, F.when(m.isNotNull(), F.greatest(F.lit(0.0), center - half)),
            F.when(m.isNotNull(), F.least(F.lit(1.0), center + half)))
