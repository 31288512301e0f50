"""Exact medians that stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import c

# Rank error of the percentile sketch is at most cells / ACCURACY; up to ACCURACY cells it is exact.
ACCURACY = 10_000


class _Search:
    """The open interval that holds both middle ranks of one column, and how many cells lie below it."""

    def __init__(self, name: str, cells: int):
        self.name = name
        self.ranks = ((cells - 1) // 2, cells // 2)
        self.low = self.high = None
        self.below, self.inside = 0, cells

    def inner(self) -> Column:
        v = c(self.name)
        mask = v.isNotNull()
        if self.low is not None:
            mask = mask & (v > self.low)
        if self.high is not None:
            mask = mask & (v < self.high)
        return F.when(mask, v)

    def shares(self) -> list[float]:
        slack = 0.0 if self.inside <= ACCURACY else 2.0 / ACCURACY
        first, last = (r - self.below + 1 for r in self.ranks)
        return [max(0.0, first / self.inside - slack), min(1.0, last / self.inside + slack)]

    def aggregates(self, i: int, low, high) -> list[Column]:
        """Cells by where they lie, and the values next to the two edges."""
        v = self.inner()
        return [
            F.count(F.when(v < low, 1)).alias(f"under_{i}"), F.count(F.when(v == low, 1)).alias(f"low_{i}"),
            F.count(F.when((v > low) & (v < high), 1)).alias(f"between_{i}"),
            F.count(F.when(v == high, 1)).alias(f"high_{i}"),
            F.max(F.when(v < low, v)).alias(f"before_{i}"), F.min(F.when(v > low, v)).alias(f"next_{i}"),
            F.max(F.when(v < high, v)).alias(f"previous_{i}"), F.min(F.when(v > high, v)).alias(f"after_{i}"),
        ]

    def narrow(self, i: int, low, high, row) -> list | None:
        """The two middle values, or None after the interval became smaller."""
        parts = [("under", row[f"under_{i}"], row[f"before_{i}"], None), ("low", row[f"low_{i}"], low, low)]
        if low != high:
            parts += [("between", row[f"between_{i}"], row[f"previous_{i}"], row[f"next_{i}"]),
                      ("high", row[f"high_{i}"], high, high)]
        over = self.inside - sum(p[1] for p in parts)
        parts.append(("over", over, None, row[f"after_{i}"]))
        at, places = self.below, []
        for rank in self.ranks:
            start = at
            for name, n, last, first in parts:
                if rank < start + n:
                    places.append((name, start, n, last, first))
                    break
                start += n
        (name, start, n, last, first), (name2, _, _, _, first2) = places
        if name != name2:
            # Adjacent ranks in two parts: the greatest of one and the smallest of the other.
            return [last, first2]
        if name in ("low", "high"):
            return [first, first]
        bounds = {"under": (self.low, low), "between": (low, high), "over": (high, self.high)}[name]
        if (bounds, n) == ((self.low, self.high), self.inside):
            raise RuntimeError(f"the median of {self.name!r} cannot be narrowed down")
        (self.low, self.high), self.below, self.inside = bounds, start, n
        return None


def exact_medians(df: DataFrame, columns: list[str], counts: dict[str, int] | None = None) -> dict[str, float | None]:
    """Median per column, the mean of the two middle values, missing ignored.

    A percentile sketch names two values around the middle ranks, and one
    pass counts the cells below, at, between and above them. Middle ranks that
    fall on a value, or on the border of two parts, are found; otherwise the
    part that holds them is searched in the same way. An edge is a value of
    the column and never part of the next interval, so every round is over
    fewer values, ties included. All columns share each pass, and values keep
    their own type.
    """
    if not columns:
        return {}
    if counts is None:
        row = df.agg(*[F.count(c(n)).alias(f"n_{i}") for i, n in enumerate(columns)]).first()
        counts = {n: row[f"n_{i}"] for i, n in enumerate(columns)}
    medians: dict[str, float | None] = {n: None for n in columns if counts[n] == 0}
    open_ = [_Search(n, counts[n]) for n in columns if counts[n]]
    while open_:
        edges = df.agg(*[F.percentile_approx(s.inner(), s.shares(), ACCURACY).alias(f"p_{i}")
                         for i, s in enumerate(open_)]).first()
        row = df.agg(*[a for i, s in enumerate(open_) for a in s.aggregates(i, *edges[f"p_{i}"])]).first()
        still = []
        for i, s in enumerate(open_):
            found = s.narrow(i, *edges[f"p_{i}"], row)
            if found is None:
                still.append(s)
            else:
                medians[s.name] = (found[0] + found[1]) / 2
        open_ = still
    return medians
