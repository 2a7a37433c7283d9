"""Results of several runs: seeds, hyper-parameters, training times, job outputs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from florapark.functions.scores import finite_or_null
from florapark.operators.ranking import group_median, spread


def finite(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn(value, finite_or_null(value)).where(F.col(value).isNotNull())


def seed_summary(runs: DataFrame, keys: Sequence[str] = ("species_id",)) -> DataFrame:
    """Mean, population deviation (null below two seeds) and number of seeds per species."""
    return finite(runs).groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        F.when(F.count("*") >= 2, F.stddev_pop("value")).alias("std"),
        F.count("*").alias("n_seeds"),
    )


def macro_over_seeds(runs: DataFrame, n_seeds: int, by: Sequence[str] = ()) -> DataFrame:
    """Per-seed mean and median, over all and over common species, then mean and deviation over seeds.

    ``by`` may name the metric; species are then common per metric.
    """
    good = finite(runs)
    complete = good.groupBy(*by, "species_id").agg(F.count_distinct("seed").alias("k")).where(F.col("k") == n_seeds)
    sets = good.withColumn("species_set", F.lit("union")).unionByName(
        good.join(complete, [*by, "species_id"], "left_semi").withColumn("species_set", F.lit("common")))
    keys = [*by, "species_set", "seed"]
    per_seed = sets.groupBy(*keys).agg(F.avg("value").alias("mean")).join(
        group_median(sets, keys, "value", "median"), keys)
    return per_seed.groupBy(*by, "species_set").agg(
        F.avg("mean").alias("mean"), F.when(F.count("*") >= 2, F.stddev_pop("mean")).alias("mean_std"),
        F.avg("median").alias("median"), F.when(F.count("*") >= 2, F.stddev_pop("median")).alias("median_std"),
        F.count("*").alias("n_seeds"),
    )


def seed_coverage(runs: DataFrame, species: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many species are finite in exactly n seeds, n = 0 included; ``by`` may name the metric."""
    known = species.select("species_id").distinct()
    per_species = finite(runs).join(known, "species_id", "left_semi").groupBy(*by, "species_id").agg(
        F.count_distinct("seed").alias("n_seeds"))
    seen = per_species.groupBy(*by, "n_seeds").agg(F.count("*").alias("n_species"))
    # species without a finite score are those that are left over
    held = seen.groupBy(*by).agg(F.sum("n_species").alias("_held"))
    groups = runs.select(*by).distinct().join(held, list(by), "left") if by else held
    total = known.agg(F.count("*").alias("n")).scalar()
    unseen = groups.select(*by, F.lit(0).cast("bigint").alias("n_seeds"), (total - F.coalesce("_held", F.lit(0))).alias("n_species"))
    return seen.unionByName(unseen.where("n_species > 0"))


def select_hyperparameter(runs: DataFrame, grid: Sequence[float], param: str = "param") -> DataFrame:
    """Per species the grid value with the best score; earlier grid value wins ties."""
    position = F.array_position(F.array(*[F.lit(float(g)) for g in grid]), F.col(param).cast("double"))
    best = F.max_by(F.struct(param, "value"), F.struct(F.col("value"), -position))
    return (
        finite(runs).where(position > 0).groupBy("species_id").agg(best.alias("b"))
        .select("species_id", F.col(f"b.{param}").alias(param), F.col("b.value").alias("score"))
    )


def selection_distribution(selected: DataFrame, grid: Sequence[float], param: str = "param") -> DataFrame:
    """Species per chosen value, share, and whether more than half sit at the ends of the grid."""
    ends = F.col(param).cast("double").isin(float(min(grid)), float(max(grid)))
    totals = selected.agg(F.struct(F.count("*").alias("n"), F.count_if(ends).alias("at_ends")).alias("t")).scalar()
    return (
        selected.groupBy(param).agg(F.count("*").alias("n_species")).withColumn("_t", totals)
        .select(
            param, "n_species",
            F.try_divide(F.col("n_species").cast("double"), F.col("_t.n")).alias("share"),
            (F.col("_t.at_ends") * 2 > F.col("_t.n")).alias("mostly_at_ends"),
        )
    )


def training_time_summary(times: DataFrame, seconds: str = "train_time_seconds") -> DataFrame:
    t = finite(times, seconds)
    return t.agg(
        F.sum(seconds).alias("total_seconds"), (F.sum(seconds) / 3600).alias("total_hours"),
        F.count_distinct("species_id").alias("species_timed"),
        F.try_divide(F.sum(seconds), F.count_distinct("species_id").cast("double")).alias("mean_seconds_per_species"),
    )


def model_score(
    results: DataFrame, species: DataFrame, metric: str, species_name: str | None = None, at_once: bool = True
) -> DataFrame:
    """Scores of one metric with species names; an absent metric is an error that names those there are.

    The error is raised by the call, or while the rows are read if not ``at_once``, when
    the call runs no job.
    """
    got = results.where(F.col("metric") == metric)
    if at_once and got.isEmpty():
        there = sorted(r["metric"] or "" for r in results.select("metric").distinct().collect())
        raise ValueError(f"metric {metric!r} not in results; available: {there}")
    if not at_once:
        message = F.concat(F.lit(f"metric {metric!r} not in results; available: "), F.to_json("names"))
        known = results.agg(
            F.count_if(F.col("metric") == metric).alias("n"), F.sort_array(F.collect_set("metric")).alias("names"),
        ).select(F.when(F.col("n") > 0, True).otherwise(F.raise_error(message).cast("boolean")))
        got = got.where(known.scalar())
    named = got.join(species.select("species_id", "species_name"), "species_id")
    return named if species_name is None else named.where(F.col("species_name") == species_name)


def needs_evaluation(models: DataFrame, metrics: DataFrame) -> DataFrame:
    """Fitted species without any defined metric."""
    done = finite(metrics).select("species_id").distinct()
    return models.select("species_id").distinct().join(done, "species_id", "left_anti")


def missing_models(species: DataFrame, models: DataFrame) -> DataFrame:
    return species.select("species_id").distinct().join(models.select("species_id").distinct(), "species_id", "left_anti")


# ---- joining the outputs of jobs that each worked on part of the species ----


def merge_job_metrics(parts: DataFrame, keys: Sequence[str] = ("species_id", "metric"), order: str = "job_order") -> DataFrame:
    """Defined values only; the later job wins."""
    return finite(parts).groupBy(*keys).agg(F.max_by("value", order).alias("value"))


def merge_job_predictions(slices: Sequence[DataFrame], species: DataFrame, rows: int = 0) -> DataFrame:
    """All species; those that no slice covers get null location and probability.

    ``rows``: about as many predictions there are, so that tasks follow them.
    """
    stacked = spread(reduce(DataFrame.unionByName, slices), rows, "species_id")
    return species.select("species_id").join(stacked, "species_id", "left")


def merge_training_times(parts: DataFrame, order: Sequence[str] = ("part_no", "row_order")) -> DataFrame:
    """First row per species over all parts, in part order."""
    row = F.min_by(F.struct("part_no", "train_time_seconds"), F.struct(*order)).alias("r")
    return parts.groupBy("species_id").agg(row).select("species_id", "r.part_no", "r.train_time_seconds")


def training_time_status(merged: DataFrame, seconds: str = "train_time_seconds") -> DataFrame:
    ok = finite_or_null(seconds).isNotNull()
    return merged.agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"))


def copy_shared_columns(table: DataFrame, siblings: Sequence[DataFrame], columns: Sequence[str], key: str = "species_id") -> DataFrame:
    """Fill the listed columns that ``table`` lacks or has null, the first sibling with a value winning."""
    out = table
    for name in columns:
        choices: list[Column] = [F.col(name)] if name in table.columns else []
        for i, sibling in enumerate(siblings):
            if name in sibling.columns:
                tag = f"_{name}_{i}"
                out = out.join(sibling.select(key, F.col(name).alias(tag)), key, "left")
                choices.append(F.col(tag))
        if choices:
            out = out.withColumn(name, F.coalesce(*choices))
    return out.select(*[c for c in out.columns if not c.startswith("_")])
