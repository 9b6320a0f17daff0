"""Pair statistics as column expressions.

All of them take the margins ``n_a``, ``n_b``, the joint count ``n_ab`` and the number of units
``n_total`` of a 2x2 table and stay accurate for billions of units: nothing subtracts two large
log-factorials, the leading terms cancel analytically.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the numeric helpers travel with the task, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)
_SMALL = 16
# log n! minus its leading Stirling part (n + 1/2) log n - n + log(2 pi)/2, for n = 0..15; n = 0 is not used
_REMAINDER_SMALL = [0.0] + [
    math.log(math.factorial(n)) - ((n + 0.5) * math.log(n) - n + _HALF_LOG_2PI) for n in range(1, _SMALL)
]


def _d(c: Column) -> Column:
    return c.cast("double")


def _stirling_remainder(n: Column) -> Column:
    small = F.element_at(
        F.array(*[F.lit(v) for v in _REMAINDER_SMALL]), (F.least(n, F.lit(float(_SMALL - 1))) + 1).cast("int")
    )
    r = F.lit(1.0) / (n * n)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / n
    return F.when(n < _SMALL, small).otherwise(series)


def log_factorial(n: Column) -> Column:
    """log n! by Stirling's series; exact small values below 16."""
    n = _d(n)
    return F.when(n <= 1, F.lit(0.0)).otherwise(
        (n + 0.5) * F.log(n) - n + _HALF_LOG_2PI + _stirling_remainder(n)
    )


def expected(n_a: Column, n_b: Column, n_total: Column) -> Column:
    return _d(n_a) * _d(n_b) / F.greatest(_d(n_total), F.lit(1.0))


def pmi(n_ab: Column, exp: Column) -> Column:
    return F.when(n_ab > 0, F.log2(_d(n_ab) / exp))


def _cells(n_ab: Column, n_a: Column, n_b: Column, n_total: Column) -> tuple[list[Column], list[Column], list[Column]]:
    x, a, b, n = _d(n_ab), _d(n_a), _d(n_b), F.greatest(_d(n_total), F.lit(1.0))
    observed = [x, a - x, b - x, n - a - b + x]
    expectation = [a * b / n, a * (n - b) / n, (n - a) * b / n, (n - a) * (n - b) / n]
    gap = x - a * b / n  # every cell is off by this amount, with alternating sign
    return observed, expectation, [gap, -gap, -gap, gap]


def g2(n_ab: Column, n_a: Column, n_b: Column, n_total: Column) -> Column:
    """Log-likelihood ratio; a cell with no observations or no expectation adds nothing."""
    total = F.lit(0.0)
    for k, e, gap in zip(*_cells(n_ab, n_a, n_b, n_total)):
        # log(k/e) written as log1p((k-e)/e), which keeps its digits when k is close to e
        total = total + F.when((k > 0) & (e > 0), k * F.log1p(gap / e)).otherwise(F.lit(0.0))
    return total * 2.0


def _remainder_array(v: np.ndarray) -> np.ndarray:
    w = np.maximum(v, 1.0)
    r = 1.0 / (w * w)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / w
    return np.where(v < _SMALL, np.asarray(_REMAINDER_SMALL)[np.minimum(v, _SMALL - 1).astype(np.int64)], series)


def _log_point_array(x: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log P(X = x): minus the deviance of the 2x2 table plus slowly varying corrections.

    The leading n log n terms of the nine log-factorials cancel into the deviance, so nothing
    large is subtracted and the result keeps its digits for billions of units.
    """
    def part(v):
        return np.where(v > 0, 0.5 * np.log(np.maximum(v, 1.0)) + _HALF_LOG_2PI + _remainder_array(v), 0.0)

    gap = x - a * b / n
    total = part(a) + part(n - a) + part(b) + part(n - b) - part(n)
    for seen, sign, other_a, other_b in (
        (x, 1, a, b), (a - x, -1, a, n - b), (b - x, -1, n - a, b), (n - a - b + x, 1, n - a, n - b),
    ):
        e = other_a * other_b / n
        counted = (seen > 0) & (e > 0)
        rel = np.where(counted, sign * gap / np.where(counted, e, 1.0), 0.0)
        total = total - part(seen) - np.where(counted, seen * np.log1p(rel), 0.0)
    return total


def upper_tail(x: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """P(X >= x) elementwise. Above the mean the upper tail is summed from its first term by term
    ratios until terms stop mattering; below it the lower tail is summed and taken from one."""
    k, m = np.minimum(a, b), np.maximum(a, b)  # symmetric: mirrored pairs get the identical value
    mean, floor = k * m / n, np.maximum(k + m - n, 0.0)
    single = (x == 1) & (floor == 0)  # P(X >= 1) = 1 - P(0)
    up = (x > mean) & ~single
    y = np.where(up, x, np.maximum(x - 1.0, floor))
    point = _log_point_array(y, k, m, n)
    rest = n - k - m + y
    num1, num2 = np.where(up, k - y, y), np.where(up, m - y, rest)
    den1, den2 = np.where(up, y, k - y) + 1.0, np.where(up, rest, m - y) + 1.0
    total = np.ones_like(y)
    live = np.flatnonzero(~single & (x > floor))
    n1, n2, d1, d2 = (v[live] for v in (num1, num2, den1, den2))
    term, acc, j = np.ones(len(live)), np.ones(len(live)), 0.0
    while len(live):
        term = term * ((n1 - j) * (n2 - j) / ((d1 + j) * (d2 + j)))
        acc = acc + term
        total[live] = acc
        # the ratios fall with j, so terms this small no longer reach the sum
        more = term > acc * 1e-22
        live, n1, n2, d1, d2, term, acc = (v[more] for v in (live, n1, n2, d1, d2, term, acc))
        j += 1.0
    tail = np.where(single, -np.expm1(point), np.where(up, np.exp(point) * total, 1.0 - np.exp(point) * total))
    return np.where(x <= floor, 1.0, np.clip(tail, 0.0, 1.0))


@F.pandas_udf(T.DoubleType())
def hypergeom_sf(n_ab: pd.Series, n_a: pd.Series, n_b: pd.Series, n_total: pd.Series) -> pd.Series:
    """Exact P(X >= n_ab) for X hypergeometric; null when the pair never occurs.

    Arrow batches of numbers in, one number out, no shuffle. The same sum as a higher-order
    function in the JVM is interpreted per term and took three to five times as long.
    """
    x, a, b, n = (v.to_numpy(dtype="float64") for v in (n_ab, n_a, n_b, n_total))
    seen = x > 0
    p = np.full(len(x), np.nan)
    p[seen] = upper_tail(x[seen], a[seen], b[seen], n[seen])
    return pd.Series(p).astype(object).where(seen, None) if not seen.all() else pd.Series(p)


def direction(n_ab: Column, exp: Column) -> Column:
    return F.when(n_ab > exp, "association").when(n_ab < exp, "avoidance").otherwise("neutral")


def ratio(n_ab: Column, exp: Column) -> Column:
    return F.when(exp > 0, n_ab / exp)


def concentrated(share: Column, limit: float = 0.5) -> Column:
    return F.coalesce(share >= limit, F.lit(False))


def finding_class(
    status_changed: Column,
    significant: Column,
    other_significant: Column,
    direct: Column,
    exp: Column,
    share: Column,
) -> Column:
    """One label per pair row; earlier rules win. ``other_significant`` is null without a counterpart."""
    flipped = status_changed & other_significant.isNotNull()
    return (
        F.when(flipped & significant & ~other_significant, "flip_lost")
        .when(flipped & ~significant & other_significant, "flip_gained")
        .when(flipped, "flip_direction")
        .when(direct == "avoidance", "avoidance")
        .when(~significant & (exp < 2), "weak_data")
        .when(~significant, "not_significant")
        .when(concentrated(share), "significant_concentrated")
        .otherwise("significant")
    )
