"""Predictor columns: arrays of doubles, null where a predictor is missing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from florapark.functions.scores import finite_or_null

LEVELS = 50  # fixed value: thresholds and hinge knots per predictor
SPAN = (-3.0, 3.0)
CODES = "lqpth"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def levels(n: int = LEVELS) -> list[float]:
    lo, hi = SPAN
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)]


def as_doubles(x: Column | str) -> Column:
    """Array of doubles with NaN and infinities as null."""
    return F.transform(_col(x), finite_or_null)


def select_predictors(groups: dict[str, Sequence[int]]) -> Column:
    """Chosen positions of each group column, one after the other; the location is never a feature."""
    parts = [F.array(*[F.get(F.col(g), i) for i in idx]) for g, idx in groups.items() if g != "location" and len(idx)]
    return F.concat(*parts)


def impute(x: Column | str, means: Column) -> Column:
    return F.zip_with(_col(x), means, lambda v, m: F.coalesce(v, m))


def normalise(x: Column | str, means: Column, stds: Column, zero_std_as_one: bool = False) -> Column:
    """Missing to mean, then z-score; a zero deviation gives null, or counts as 1."""
    centred = F.zip_with(impute(x, means), means, lambda v, m: v - m)
    if zero_std_as_one:
        stds = F.transform(stds, lambda s: F.when(s == 0, F.lit(1.0)).otherwise(s))
    return F.zip_with(centred, stds, lambda v, s: F.try_divide(v, s))


def encode_location(lon: Column | str, lat: Column | str) -> Column:
    a, b = F.lit(math.pi) * _col(lon) / 180, F.lit(math.pi) * _col(lat) / 90
    return F.array(F.sin(a), F.cos(a), F.sin(b), F.cos(b))


def linear_plus_squares(x: Column | str) -> Column:
    x = _col(x)
    return F.concat(x, F.transform(x, lambda v: v * v))


def maxent_features(x: Column | str, codes: str = "l", n_thresholds: int = LEVELS, n_hinges: int = LEVELS) -> Column:
    """Feature classes in the order l, q, p, t, h: as is, squares, product of all, steps, hinges."""
    wrong = [c for c in codes if c not in CODES]
    if wrong:
        raise ValueError(f"unknown feature codes {wrong}; allowed: {', '.join(CODES)}")
    x = _col(x)
    parts = []
    if "l" in codes:
        parts.append(x)
    if "q" in codes:
        parts.append(F.transform(x, lambda v: v * v))
    if "p" in codes:
        parts.append(F.array(F.aggregate(x, F.lit(1.0), lambda a, v: a * v)))
    if "t" in codes:
        cuts = doubles(levels(n_thresholds))
        parts.append(F.flatten(F.transform(x, lambda v: F.transform(cuts, lambda c: (v > c).cast("double")))))
    if "h" in codes:
        knots = doubles(levels(n_hinges))
        parts.append(F.flatten(F.transform(x, lambda v: F.transform(knots, lambda k: F.greatest(v - k, F.lit(0.0))))))
    if not parts:
        return x
    return F.concat(*parts)


def feature_class(n_presences: Column | str) -> Column:
    n = _col(n_presences)
    return F.when(n < 10, "l").when(n < 15, "lq").when(n < 100, "lqp").otherwise("lqpht")


def spline_basis(x: Column | str, n_splines: int = 10, lo: float = SPAN[0], hi: float = SPAN[1]) -> Column:
    """Cubic B-spline columns of every predictor over evenly spaced knots.

    Each value is placed on the knot scale; a basis function is the cubic kernel at
    the distance of its centre. Values beyond the ends are held at the ends.
    """
    step = (hi - lo) / (n_splines - 3)
    centres = F.sequence(F.lit(-1), F.lit(n_splines - 2))

    def kernel(u: Column) -> Column:
        a = F.abs(u)
        inner = (4 - 6 * a * a + 3 * a * a * a) / 6
        outer = F.pow(2 - a, F.lit(3.0)) / 6
        return F.when(a < 1, inner).when(a < 2, outer).otherwise(0.0)

    def one(v: Column) -> Column:
        at = (F.greatest(F.lit(lo), F.least(F.lit(hi), v)) - lo) / step
        return F.transform(centres, lambda k: kernel(at - k))

    return F.flatten(F.transform(_col(x), one))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
