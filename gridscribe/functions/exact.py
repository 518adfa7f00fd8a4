"""Fisher's exact test of 2 x 2 tables, in Arrow batches of summed counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Terms that are made at once, and the share of a sum's first term below which the rest no longer counts.
STRIDE, TINY = 1 << 14, 1e-20
#: Tables are as likely as the one at hand if their chances differ by this share at most.
EQUAL = 1e-7
#: Chances below this share of the likeliest one's are not followed from there.
LEAST = 1e-280


def _outward(x: int, row: int, col: int, n: int, step: int) -> Iterator[np.ndarray]:
    """Chances of the tables beyond x to one side as shares of x's own, in strides: running products of the ratios of neighbours."""
    low, high, share, free = max(0, row + col - n), min(row, col), 1.0, float(n - row - col)
    while share > 0 and (x < high if step > 0 else x > low):
        many = min(STRIDE, high - x if step > 0 else x - low)
        at = x + step * np.arange(many, dtype=np.float64)
        if step > 0:
            ratio = (row - at) * (col - at) / ((at + 1) * (free + at + 1))
        else:
            ratio = at * (free + at) / ((row - at + 1) * (col - at + 1))
        terms = share * np.cumprod(ratio)
        yield terms
        share, x = float(terms[-1]), x + step * many


def _sum(terms: Iterator[np.ndarray], least: float, most: float = math.inf) -> float:
    """Sum of the terms that are `most` at most, until they fall below `least`."""
    total = 0.0
    for t in terms:
        total += math.fsum(t[t <= most])
        if t[-1] < least:
            break
    return total


def two_sided(a: int, b: int, c: int, d: int) -> float:
    """Chance of a table at most as likely as this one with its margins; 1 where a margin is empty.

    Chances follow from the likeliest table outward, as shares of its own, until they vanish: some root of the number of cases times ten, whatever the number is. A chance below
    LEAST of it comes from log-gammas, with its own tail alone.
    """
    n, row, col = a + b + c + d, a + b, a + c
    if not (row and c + d and col and b + d):
        return 1.0
    mode = (row + 1) * (col + 1) // (n + 2)
    side = 1 if a > mode else -1
    here, left = (1.0 if a == mode else None), abs(a - mode)
    for terms in _outward(mode, row, col, n, side) if left else ():
        if left <= len(terms):
            here = float(terms[left - 1])
            break
        left -= len(terms)
        if terms[-1] < LEAST:
            break
    beyond = 1.0 + _sum(_outward(a, row, col, n, side), TINY)
    if here is None or here < LEAST:
        log = lambda x: math.lgamma(x + 1.0)
        return math.exp(log(row) + log(n - row) + log(col) + log(n - col) - log(n) - log(a) - log(b) - log(c) - log(d)) * beyond
    most = here * (1 + EQUAL)
    if most >= 1:
        return 1.0
    other = _sum(_outward(mode, row, col, n, -side), TINY * here, most)
    whole = 1.0 + sum(_sum(_outward(mode, row, col, n, s), TINY) for s in (1, -1))
    return min(1.0, (here * beyond + other) / whole)


@F.pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([two_sided(*map(int, x)) for x in zip(a, b, c, d)], dtype="float64")
