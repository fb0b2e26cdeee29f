"""Exact quantiles of whole tables, by counting: no task sees more than a bounded number of values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of one rank's range that are sorted at once; classes that a larger range is cut into.
LIMIT, CLASSES = 10_000, 1024
#: Ranges end here at the latest, so that their width is a finite number.
FAR = 4e307


@dataclass
class _Rank:
    """The value of one rank: it is the ``rank``-th (from 0) of the ``count`` values of ``column`` in [``low``, ``high``]."""

    column: str
    rank: int
    low: float
    high: float
    count: int


def _class(value, low: float, high: float):
    """Class of a value in its range, from 0: the same order as the values'."""
    low, high = max(low, -FAR), min(high, FAR)
    inner = F.floor((value - F.lit(low)) / F.lit((high - low) / CLASSES))
    return F.greatest(F.lit(0), F.least(F.lit(CLASSES - 1), inner)).cast("int")


def _targets(df: DataFrame, ranks: list[_Rank], classed: bool) -> DataFrame:
    """``target, v`` and, if ``classed``, ``c``: each value in the range of a rank, by the rank's number."""
    found = []
    for i, r in enumerate(ranks):
        v = F.col(f"`{r.column}`")
        inside = v.between(F.lit(r.low), F.lit(r.high))
        found.append(F.when(inside, F.struct(F.lit(i).alias("target"), v.alias("v"), *([_class(v, r.low, r.high).alias("c")] if classed else []))))
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("t")).select("t.*")


def quantiles(df: DataFrame, shares: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """For each column the exact quantiles of its numbers, between two values in proportion; NULL and NaN do not count, without numbers None.

    The range of each rank asked for is cut into classes of equal width, the values are counted by class with partial
    aggregation, and the class that holds the rank is the next range, until it has few values or one only.  The driver gets
    counts of classes, and at most ``LIMIT`` values a rank.
    """
    names = list(shares)
    numbers = df.select(*(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) for c in names))
    whole = numbers.agg(*(f(f"`{c}`").alias(f"{n}_{i}") for i, c in enumerate(names) for n, f in (("n", F.count), ("low", F.min), ("high", F.max)))).first()
    wanted: dict[tuple[str, int], float | None] = {}
    open_: list[_Rank] = []
    for i, c in enumerate(names):
        n = whole[f"n_{i}"]
        for rank in sorted({f(s * (n - 1)) for s in shares[c] for f in (floor, ceil)}) if n else ():
            open_.append(_Rank(c, rank, whole[f"low_{i}"], whole[f"high_{i}"], n))
    asked = {id(r): (r.column, r.rank) for r in open_}
    while open_:
        for r in [r for r in open_ if r.low == r.high]:
            wanted[asked[id(r)]] = r.low
        open_ = [r for r in open_ if r.low < r.high]
        large = [r for r in open_ if r.count > LIMIT]
        if not large:
            break
        rows = _targets(numbers, large, True).groupBy("target", "c").agg(F.count("*"), F.min("v"), F.max("v")).collect()
        for i, r in enumerate(large):
            for _, _, n, low, high in sorted((row for row in rows if row[0] == i), key=lambda row: row[1]):
                if r.rank < n:
                    r.low, r.high, r.count = low, high, n
                    break
                r.rank -= n
    if open_:
        # equal ranges are read once
        ranges = list({(r.column, r.low, r.high): r for r in open_}.values())
        values: dict[tuple[str, float, float], list[float]] = {(r.column, r.low, r.high): [] for r in ranges}
        for i, v in _targets(numbers, ranges, False).collect():
            values[ranges[i].column, ranges[i].low, ranges[i].high].append(v)
        for found in values.values():
            found.sort()
        for r in open_:
            wanted[asked[id(r)]] = values[r.column, r.low, r.high][r.rank]

    def between(c: str, n: int, share: float) -> float | None:
        if not n:
            return None
        at = share * (n - 1)
        low, high = wanted[c, floor(at)], wanted[c, ceil(at)]
        return low if low == high else low + (high - low) * (at - floor(at))

    return {c: [between(c, whole[f"n_{i}"], s) for s in shares[c]] for i, c in enumerate(names)}


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """The exact median of each column, as :func:`quantiles`."""
    return {c: found[0] for c, found in quantiles(df, {c: [0.5] for c in columns}).items()}
