"""Draws and samples used by the corpus operators; tables and code go through ``florapark.session``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from florapark.session import drop, pin, ship

__all__ = ["drop", "few", "held_back", "pin", "sample_per_class", "ship", "unit_hash"]


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A repeatable draw in [0, 1) from the given columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11).cast("double") / float(1 << 53)


def few(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``ids`` written down, and sent to all executors if they are at most ``most`` narrow rows; else they are joined by a shuffle."""
    kept = pin(ids)
    return F.broadcast(kept) if kept.count() <= most else kept


def held_back(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sample_per_class(rows: DataFrame, label: str, key: Column, per_class: int, seed: int) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each value of ``label``, drawn by hash of ``key``, with the count of each value.

    Draws by a threshold on a hash, so that nothing is sorted and no class meets in
    one task. The expected size is the bound times the number of classes.
    """
    counts: Mapping = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows, {}
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(rate)
    return rows.where(unit_hash(key, seed=seed) < rate), dict(counts)
