"""Prediction tables: wide to long, validation, truth labels, writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from florapark.functions.scores import finite_or_null

COORDINATES = ("longitude", "latitude", "lon", "lat")
TOLERANCE = 1e-6


def read_wide(wide: DataFrame, key: str = "location_id", drop: Sequence[str] = COORDINATES) -> DataFrame:
    """One probability column per species to (location, species, probability); species_id = column position."""
    columns = [c for c in wide.columns if c != key and c.lower() not in drop]
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    return wide.select(key, F.posexplode(values).alias("species_id", "probability"))


def validate(pred: DataFrame, num_species: int | Column | None = None, truth: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """One row of counts: species found, missing or infinite values, values off [0, 1], keys without partner.

    ``num_species`` may be a scalar column, so that counting the species is part of the plan.
    In strict mode the row raises an error when a check fails.
    """
    p = F.col("probability").cast("double")
    bad_value = finite_or_null("probability").isNull()
    off = ~bad_value & ~p.between(-TOLERANCE, 1 + TOLERANCE)
    report = pred.agg(
        F.count("*").alias("n_rows"), F.count_distinct("species_id").alias("n_species"),
        F.count_if(bad_value).alias("n_not_finite"), F.count_if(off).alias("n_out_of_range"),
    )
    if truth is not None:
        keys = ["location_id", "species_id"]
        a = pred.select(*keys).withColumn("_a", F.lit(1))
        b = truth.select(*keys).withColumn("_b", F.lit(1))
        pairs = a.join(b, keys, "full_outer").agg(F.struct(
            F.count_if(F.col("_a").isNull()).alias("x"), F.count_if(F.col("_b").isNull()).alias("y")).alias("s")).scalar()
        report = report.withColumn("_s", pairs).select(
            "*", F.col("_s.x").alias("n_truth_only"), F.col("_s.y").alias("n_pred_only")).drop("_s")
    else:
        report = report.withColumns({"n_truth_only": F.lit(0).cast("bigint"), "n_pred_only": F.lit(0).cast("bigint")})
    ok = (F.col("n_not_finite") == 0) & (F.col("n_out_of_range") == 0) & (F.col("n_truth_only") == 0) & (F.col("n_pred_only") == 0)
    if num_species is not None:
        ok = ok & (F.col("n_species") == num_species)
    if strict:
        ok = F.when(ok, True).otherwise(F.raise_error(F.lit("prediction table failed validation")).cast("boolean"))
    return report.withColumn("valid", ok)


def attach_truth(pred: DataFrame, truth: DataFrame, label: str = "label") -> DataFrame:
    """Labels bundled with the predictions win, else the separate truth table."""
    other = truth.select("location_id", "species_id", F.col(label).alias("_truth"))
    bundled = F.col(label) if label in pred.columns else F.lit(None).cast("int")
    return pred.join(other, ["location_id", "species_id"], "left").withColumn(label, F.coalesce(bundled, "_truth")).drop("_truth")


def prediction_table(pred: DataFrame, locations: DataFrame, run: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(long predictions with masked labels, location attributes).

    The sampled area is kept only if every location has one.
    """
    long = pred.select(F.lit(run).alias("run"), F.lit(seed).alias("seed"), "location_id", "species_id", "probability", "label")
    used = locations.join(pred.select("location_id").distinct(), "location_id", "left_semi")
    complete = used.agg((F.count("sampled_area_m2") == F.count("*")).alias("c")).scalar()
    place = used.select("location_id", "lon", "lat", F.when(complete, F.col("sampled_area_m2")).alias("sampled_area_m2"))
    return long, place


def write_predictions(pred: DataFrame, locations: DataFrame, path: str, run: str, seed: int) -> None:
    long, place = prediction_table(pred, locations, run, seed)
    long.write.mode("overwrite").partitionBy("run", "seed").parquet(f"{path}/prediction")
    place.write.mode("overwrite").parquet(f"{path}/location")
