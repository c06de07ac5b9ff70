"""Numeric expressions: closeness, distances, losses and skill. A missing value is null everywhere."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row; named inside a lambda it would be computed at each step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


QUANTILES = tuple(i / 10 for i in range(1, 10))
QUANTILE_NAMES = tuple(f"q{q:g}" for q in QUANTILES)
EARTH_KM = 6371.0


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether a is within ``atol + rtol * |b|`` of b; false if either is missing."""
    return F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), F.lit(False))


def no_nan(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


def sentinel_to_null(c: Column, at_most: float) -> Column:
    """Values at or below a sentinel as null."""
    return F.when(c > at_most, c)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance rounded to 0.1 km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.sin((p2 - p1) / 2) ** 2 + F.cos(p1) * F.cos(p2) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return F.round(2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0)))), 1)


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2)


def pinball(y: Column, predicted: Column, q: float) -> Column:
    d = y - predicted
    return F.when(d.isNotNull(), F.greatest(q * d, (q - 1) * d))


def crps(y: Column, predicted: list[Column], levels: tuple[float, ...] = QUANTILES) -> Column:
    """Twice the mean pinball loss over the levels."""
    return 2 * reduce(lambda a, b: a + b, [pinball(y, p, q) for p, q in zip(predicted, levels)]) / len(levels)


def covered(y: Column, low: Column, high: Column) -> Column:
    """1.0 or 0.0; a missing y is a miss."""
    return F.coalesce(((y >= low) & (y <= high)).cast("double"), F.lit(0.0))


def skill(loss: Column, reference: Column) -> Column:
    return 1 - F.try_divide(loss, reference)


def not_below_zero(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def standardised(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / (std + 1e-6)


def sorted_quantiles(columns: list[Column]) -> list[Column]:
    """Quantile columns rearranged into rising order within each row."""
    ordered = F.array_sort(F.array(*columns))
    return [ordered[i] for i in range(len(columns))]


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over complete pairs; null where either side has no variance."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
