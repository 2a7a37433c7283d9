"""Predictor statistics, sample and species weights, and the training loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from florapark.functions.scores import finite_or_null
from florapark.operators.properties import in_range_counts, in_range_presence, observed
from florapark.session import pin

EPSILON = 1e-5  # fixed value: keeps logarithms and quotients finite
WEIGHTED_MODELS = ("glm", "gam", "brt")  # fixed value
METHODS = (
    "inversely_proportional", "inversely_proportional_clipped", "inversely_proportional_sqrt",
    "inversely_proportional_not_normalized", "uniform",
)


def predictor_stats(background: DataFrame, predictors: str = "predictors") -> DataFrame:
    """Mean, population deviation and count per predictor position, missing values skipped."""
    one = background.select(F.posexplode(F.col(predictors)).alias("position", "v"))
    v = finite_or_null("v")
    return one.groupBy("position").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"))


def stats_arrays(stats: DataFrame) -> DataFrame:
    """The statistics as one row of two arrays in position order (one entry per predictor)."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "mean", "std")))
    return stats.agg(ordered.alias("s")).select(
        F.transform("s", lambda r: r["mean"]).alias("means"), F.transform("s", lambda r: r["std"]).alias("stds"))


def presence_background_weights(train: DataFrame, model: str) -> DataFrame:
    """Adds ``weight``: background rows weigh n_pos / n_bg for weighted models, else every row weighs 1."""
    if model not in WEIGHTED_MODELS:
        return train.withColumn("weight", F.lit(1.0))
    # pinned, so that its size is known and rows are not shuffled to meet it
    each = F.col("n") if "keys" in train.columns else F.lit(1)  # a row may hold several locations
    n = pin(train.groupBy("species_id").agg(F.sum(F.col("label") * each).alias("_p"), F.sum((1 - F.col("label")) * each).alias("_b")))
    ratio = F.try_divide(F.col("_p").cast("double"), F.col("_b"))
    return train.join(n, "species_id").withColumn(
        "weight", F.when((F.col("label") == 0) & (F.col("_p") > 0), ratio).otherwise(1.0)).drop("_p", "_b")


def loss_denominators(
    species: DataFrame, presence: DataFrame, locations: DataFrame, background: DataFrame, species_area: DataFrame | None
) -> DataFrame:
    """Per species: presences in range, in-range rows without them (at least 0), background rows in range.

    Without a mask these are plain counts.
    """
    base = species.select("species_id")
    if species_area is None:
        rows = locations.agg(F.count("*").alias("n")).scalar()
        back = background.agg(F.count("*").alias("n")).scalar()
        out = base.join(observed(presence, "_p"), "species_id", "left").select(
            "species_id", F.coalesce("_p", F.lit(0)).alias("pos_count"), rows.alias("_rows"), back.alias("bg_count"))
    else:
        out = (
            base.join(observed(in_range_presence(presence, locations, species_area), "_p"), "species_id", "left")
            .join(in_range_counts(locations, species_area, "_rows"), "species_id", "left")
            .join(in_range_counts(background, species_area, "_bg"), "species_id", "left")
            .select("species_id", F.coalesce("_p", F.lit(0)).alias("pos_count"),
                    F.coalesce("_rows", F.lit(0)).alias("_rows"), F.coalesce("_bg", F.lit(0)).alias("bg_count"))
        )
    tgb = F.greatest(F.col("_rows") - F.col("pos_count"), F.lit(0)).cast("bigint")
    return out.select("species_id", "pos_count", tgb.alias("tgb_count"), "bg_count")


def species_weight(count: Column, total: Column, method: str, clip_min: float = 0.05, clip_max: float = 20.0) -> Column:
    safe = F.greatest(count.cast("double"), F.lit(1.0))
    base = total.cast("double") / safe
    if method == "inversely_proportional":
        return base
    if method == "inversely_proportional_clipped":
        return F.greatest(F.lit(clip_min), F.least(F.lit(clip_max), base))
    if method == "inversely_proportional_sqrt":
        return F.sqrt(base)
    if method == "inversely_proportional_not_normalized":
        return 1 / safe
    if method == "uniform":
        return F.lit(1.0)
    raise ValueError(f"species weight method must be one of {METHODS}")


def default_weights(weights: DataFrame) -> DataFrame:
    """Target-group and background weights derived from the presence weight where they are not given."""
    w = F.col("weight")
    given = weights.columns
    tgb = F.col("weight_tgb") if "weight_tgb" in given else w / (w - 1 + EPSILON)
    bg = F.col("weight_bg") if "weight_bg" in given else F.lit(1.0)
    return weights.select("species_id", "weight", tgb.alias("weight_tgb"), bg.alias("weight_bg"))


def weighted_bce(pairs: DataFrame, weights: DataFrame | None = None, lambda_1: float = 1.0, lambda_2: float = 0.5) -> DataFrame:
    """One row with the three parts of the loss and their weighted sum.

    ``pairs``: species_id, probability, label, in_range, is_background. Pairs out of
    range add 0 but still count in the means.
    """
    if weights is not None:
        p = pairs.join(default_weights(weights), "species_id")
    else:
        p = pairs.withColumns({c: F.lit(1.0) for c in ("weight", "weight_tgb", "weight_bg")})
    prob, label = F.col("probability"), F.col("label").cast("double")
    mask = F.coalesce(F.col("in_range"), F.lit(True)).cast("double")
    obs = ~F.col("is_background")
    hit, miss = -F.log(prob + EPSILON), -F.log(1 - prob + EPSILON)
    parts = p.agg(
        F.avg(F.when(obs, hit * label * F.col("weight") * mask)).alias("loss_pos"),
        F.avg(F.when(obs, miss * (1 - label) * F.col("weight_tgb") * mask)).alias("loss_tgb"),
        F.coalesce(F.avg(F.when(~obs, miss * F.col("weight_bg") * mask)), F.lit(0.0)).alias("loss_bg"),
    )
    total = lambda_1 * F.col("loss_pos") + lambda_2 * F.col("loss_tgb") + (1 - lambda_2) * F.col("loss_bg")
    return parts.withColumn("loss", total)
