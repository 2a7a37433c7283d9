"""Column helpers for scores, labels and missing values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(c: Column | str) -> Column:
    """NaN and both infinities become null."""
    c = _col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def score_band(score: Column | str) -> Column:
    """Coarse band number that never decreases with the score.

    Bands are even on the logit scale, so that scores crowded near 0 or near 1, as
    those of rare species are, still spread over many bands (about 600 in all).
    """
    edge = 1e-16
    p = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), _col(score)))
    # never null, so that a join on it adds no filter of its own
    return F.coalesce(F.floor(F.log(p / (1 - p)) * 8).cast("int"), F.lit(0))


def digest(seed: int | Column, *parts: Column | str) -> Column:
    """Repeatable pseudo-random hex digest of a seed and some key columns."""
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat_ws(":", seed, *[_col(p).cast("string") for p in parts]))
