"""Contiguous ranges of ids, so that an order over all rows can be kept without one task that holds it."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

ROWS_PER_RANGE, MOST_RANGES = 4096, 1 << 14
#: Stands for a null id, which comes first.
LEAST = -(1 << 63)


def range_of(column: Column, bounds: list[int]) -> Column:
    """How many bounds the value reaches: two searches of root-many bounds each. Null: 0."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    tops = F.array(*(F.lit(c[0]) for c in chunks))
    rows = F.array(*(F.array(*(F.lit(x) for x in c)) for c in chunks))
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= column))
    return let(upto(tops), lambda i: F.when(i == 0, F.lit(0)).otherwise((i - 1) * step + F.coalesce(upto(F.get(rows, i - 1)), F.lit(0))))


@dataclass(frozen=True)
class Ranges:
    """Ranges of (id, tie): numbers ascend with them. An id with several ranges has them by slices of the tie."""

    bounds: np.ndarray  # ids at which a range begins, ascending and different
    first: np.ndarray  # number of the range that begins there; the ids before all bounds have 0
    slices: np.ndarray  # into how many the id at that bound is cut
    count: int

    def find(self, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.bounds, ids, "right") - 1
        cut = np.where(at >= 0, self.slices[at], 1) if len(self.bounds) else np.ones(len(ids), np.int64)
        number = np.where(at >= 0, self.first[at], 0) if len(self.bounds) else np.zeros(len(ids), np.int64)
        share = (ties.astype(float) + 2.0**63) / 2.0**64
        return number + np.minimum((share * cut).astype(np.int64), cut - 1)


def spread(df: DataFrame, rows: int, column: str = "doc_id") -> Ranges:
    """Ranges of about so many rows, MOST_RANGES and those of frequent ids at most. A quantile that repeats is an id
    that more than one range's rows share: it gets as many ranges of its own. The column must not be null."""
    parts = min(MOST_RANGES, max(1, df.count() // rows))
    marks = [] if parts == 1 else [int(b) for b in df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.2 / parts)]
    cuts: dict[int, int] = {}
    for b in marks:
        cuts[b] = cuts.get(b, 0) + 1
    for b in [b for b, n in cuts.items() if n > 1]:
        if b < (1 << 63) - 1:
            cuts.setdefault(b + 1, 1)  # what follows the frequent id has a range of its own
    bounds = sorted(cuts)
    slices = np.array([cuts[b] for b in bounds], np.int64)
    first = 1 + np.concatenate([[0], np.cumsum(slices)[:-1]]).astype(np.int64) if bounds else slices
    return Ranges(np.array(bounds, np.int64), first, slices, 1 + int(slices.sum()))


def number_of(column: Column, tie: Column, ranges: Ranges) -> Column:
    """Ranges.find, in built-in functions."""
    at = range_of(column, ranges.bounds.tolist())
    if not len(ranges.bounds) or ranges.slices.max() == 1:
        return at
    first = F.array(*(F.lit(int(x)) for x in [0, *ranges.first]))
    cut = F.get(F.array(*(F.lit(int(x)) for x in [1, *ranges.slices])), at)
    share = (tie.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.get(first, at) + F.least(F.floor(share * cut).cast("int"), cut - 1)
