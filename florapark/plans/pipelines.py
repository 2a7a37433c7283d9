"""Longer chains of operators."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from florapark.functions import features as X
from florapark.operators import cleaning as C, mapping as MP, metrics as M, models as L, properties as R, stratify as K, weights as W
from florapark.session import ship
from florapark.sources import predictions as P

# cells and species of one matrix product
CELL_BLOCK = 1024
SPECIES_BLOCK = 256


def score_by_area(cells: DataFrame, model: DataFrame, species_area: DataFrame) -> DataFrame:
    """Probability of a linear model for each cell and each species whose range holds the cell's area.

    ``cells`` has area_code, flat_index, features and more columns to keep. Blocks of an
    area's cells meet blocks of its species and are multiplied as matrices, so features
    travel once per ``SPECIES_BLOCK`` species and not once per species.
    """
    ship(cells.sparkSession)
    fitted = model.where(L.FITTED).select("species_id", "intercept", "coefficients")
    pairs = species_area.select("species_id", "area_code").distinct().join(fitted, "species_id")
    # at most one row per species of an area
    order = Window.partitionBy("area_code").orderBy("species_id")
    numbered = pairs.withColumn("_s", F.floor((F.row_number().over(order) - 1) / SPECIES_BLOCK))
    per_area = numbered.groupBy("area_code").agg(F.max("_s").alias("_last"))
    keys = ["area_code", "_c", "_s"]
    left = (
        cells.withColumn("_c", F.floor(F.col("flat_index") / CELL_BLOCK)).join(per_area, "area_code")
        .withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last"))).drop("_last")
    )
    blocks = cells.select(F.col("area_code").alias("_area"), F.floor(F.col("flat_index") / CELL_BLOCK).alias("_block")).distinct()
    right = numbered.join(blocks, F.col("area_code") == F.col("_area")).select(
        "_area", "_block", F.col("_s").alias("_part"), F.col("species_id").alias("_species"), "intercept", "coefficients")
    keep = [c for c in cells.columns if c != "features"]

    def product(cell: pd.DataFrame, species: pd.DataFrame) -> pd.DataFrame:
        if cell.empty or species.empty:
            return pd.DataFrame({c: [] for c in [*keep, "species_id", "probability"]})
        weights = np.vstack(species["coefficients"].to_list())
        eta = np.vstack(cell["features"].to_list()).astype(float) @ weights.T + species["intercept"].to_numpy()
        out = cell[keep].loc[cell.index.repeat(len(species))].reset_index(drop=True)
        with np.errstate(over="ignore"):
            prob = 1 / (1 + np.exp(-eta))
        return out.assign(species_id=np.tile(species["_species"].to_numpy(), len(cell)), probability=prob.ravel())

    schema = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in keep)
    species_type = model.schema["species_id"].dataType.simpleString()
    return left.groupBy(*keys).cogroup(right.groupBy("_area", "_block", "_part")).applyInPandas(
        product, f"{schema}, species_id {species_type}, probability double")


def prediction_map(
    background: DataFrame, model: DataFrame, species_area: DataFrame, bounds: DataFrame, res: float,
    mode: str = "linear", low_q: float = 10.0, high_q: float = 90.0, gamma: float = 1.0,
) -> DataFrame:
    """Map cells of every species of a linear model: (species_id, row, col, flat_index, value, scaled).

    Grid cells take the predictors of the nearest background point (background: point_id,
    lon, lat, area_code, predictors), missing ones at their mean; predictions are
    rescaled on the cells in range and null outside it.
    """
    stats = W.stats_arrays(W.predictor_stats(background))
    cells = MP.nearest_background(background, bounds, res)
    z = X.normalise(X.as_doubles("predictors"), F.col("means"), F.col("stds"), zero_std_as_one=True)
    ready = (
        cells.join(background.select("point_id", "area_code", "predictors"), "point_id")
        .withColumns({"means": stats.select("means").scalar(), "stds": stats.select("stds").scalar()})
        .select("row", "col", "flat_index", "area_code", z.alias("features"))
    )
    # the areas of a range name the cells of a species, so only cells in range are scored
    ids = model.select("species_id").distinct()
    pairs = species_area.select("species_id", "area_code").distinct().join(ids, "species_id", "left_semi")
    scored = score_by_area(ready, model, pairs).withColumnRenamed("probability", "value").withColumn("in_range", F.lit(True))
    return MP.rescale(scored, mode, low_q, high_q, gamma).drop("in_range")


class Evaluation(NamedTuple):
    """Counts of the checks, long scores per species, deltas to the reference (or None), and scores per stratum."""

    validation: DataFrame
    metrics: DataFrame
    deltas: DataFrame | None
    report: DataFrame


def _scored(pred: DataFrame, locations: DataFrame, species_area: DataFrame, truth: DataFrame | None, names: Sequence[str],
            valid: Column) -> DataFrame:
    labelled = pred if truth is None else P.attach_truth(pred, truth)
    masked = C.mask_labels(labelled, locations, species_area).where(valid)
    return M.to_long(M.compute_metrics(masked, names), names)


def evaluate_predictions(
    pred: DataFrame, locations: DataFrame, species: DataFrame, species_area: DataFrame, presence: DataFrame,
    truth: DataFrame | None = None, reference: DataFrame | None = None, properties: DataFrame | None = None,
    names: Sequence[str] = ("auroc", "auprg"), extreme_pct: float = 10.0, strict: bool = True,
) -> Evaluation:
    """From a prediction table to its report: read, validate, labels, range mask, scores, deltas, strata.

    ``pred`` and ``reference`` are long (location_id, species_id, probability[, label]) or wide, with
    one column per species in the order of their ids. Labels that come with the predictions win over ``truth``
    (location_id, species_id, label). Strata follow ``properties``, by default worked
    out from ``presence``. If ``strict``, reading any score fails when a value is missing or off
    [0, 1] or a species is absent; nothing runs before a result is read.
    """
    def opened(table: DataFrame) -> DataFrame:
        return table if "species_id" in table.columns else P.read_wide(table)

    def checked(table: DataFrame) -> DataFrame:
        return P.validate(table, n_species, strict=strict)

    n_species = species.agg(F.count("*")).scalar()
    model = opened(pred)
    validation = checked(model)

    def ok(table: DataFrame) -> Column:
        return checked(table).select("valid").scalar() if strict else F.lit(True)

    scores = _scored(model, locations, species_area, truth, names, ok(model))
    other = None
    if reference is not None:
        base = opened(reference)
        other = _scored(base, locations, species_area, truth, names, ok(base))
    if properties is None:
        properties = R.sampling_properties(species, presence, locations, species_area)
    return Evaluation(
        validation, scores, None if other is None else M.metric_delta(scores, other),
        K.stratified_report(scores, properties, reference=other, extreme_pct=extreme_pct, names=names))
