"""Spectral indices and value expressions on columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import finite
from .quantiles import medians

OPERATORS: dict[str, Callable[[Column, float], Column]] = {
    ">": lambda c, v: c > v, "<": lambda c, v: c < v, "==": lambda c, v: c == v,
    ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "!=": lambda c, v: c != v,
}


def condition_mask(value: Column, conditions: Sequence[tuple[str, float]]) -> Column:
    """True where any of the comparisons holds; NULL values are not masked."""
    if unknown := [op for op, _ in conditions if op not in OPERATORS]:
        raise ValueError(f"unknown comparison: {', '.join(unknown)}")
    return F.coalesce(reduce(Column.__or__, (OPERATORS[op](value, v) for op, v in conditions), F.lit(False)), F.lit(False))


def safe_divide(numerator: Column, denominator: Column, fill: float = 0.0) -> Column:
    """The quotient, or ``fill`` where it is not a finite number."""
    return finite(F.try_divide(numerator, denominator), fill)


def ndvi(nir: Column, red: Column) -> Column:
    return safe_divide(nir - red, nir + red)


def savi(nir: Column, red: Column, L: float = 0.5) -> Column:
    return safe_divide(nir - red, nir + red + L) * (1 + L)


def ndwi(nir: Column, green: Column) -> Column:
    return safe_divide(green - nir, green + nir)


def evi(nir: Column, red: Column, blue: Column, G: float = 2.5, C1: float = 6.0, C2: float = 7.5, L: float = 1.0) -> Column:
    return G * safe_divide(nir - red, nir + C1 * red - C2 * blue + L)


def lswi(nir: Column, swir: Column) -> Column:
    return safe_divide(nir - swir, nir + swir)


def mndwi(green: Column, swir: Column) -> Column:
    return safe_divide(green - swir, green + swir)


def ndmi(nir: Column, swir: Column) -> Column:
    return safe_divide(nir - swir, nir + swir)


def vari(red: Column, green: Column, blue: Column) -> Column:
    return safe_divide(green - red, green + red - blue)


INDICES: dict[str, Callable[..., Column]] = {f.__name__: f for f in (ndvi, savi, ndwi, evi, lswi, mndwi, ndmi, vari)}


def cap_extremes(bands: DataFrame, names: Sequence[str], limit: float = 100.0) -> DataFrame:
    """Values above ``limit`` become the exact median of their whole band. Not lazy: the medians are counted first, all together."""
    middle = medians(bands, names)
    return bands.select(*(F.when(F.col(c) > limit, F.lit(middle[c])).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in bands.columns))


def indices(bands: DataFrame, config: Mapping[str, Mapping[str, str]], keep: Sequence[str] = ("row", "col"), limit: float | None = 100.0) -> DataFrame:
    """One column per index of ``config`` ({index: {argument: band}}), in one projection over the bands."""
    if unknown := [n for n in config if n not in INDICES]:
        raise ValueError(f"unknown index: {', '.join(unknown)}")
    used = sorted({b for named in config.values() for b in named.values()})
    source = bands if limit is None else cap_extremes(bands.select(*keep, *used), used, limit)
    return source.select(*keep, *(INDICES[n](**{k: F.col(b) for k, b in named.items()}).alias(n) for n, named in config.items()))
