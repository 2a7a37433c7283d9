"""Filters, coordinate tests, quarantine and de-duplication of records."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from florapark.functions.scores import finite_or_null
from florapark.operators.ranking import first_per_group

# fixed values of the record filters
PLOT_RECORDING = ("Not specified", "All vascular plants")
RECORD_BASES = ("HUMAN_OBSERVATION", "OBSERVATION", "PRESERVED_SPECIMEN")
OCCURRENCE_COLUMNS = (
    "species", "decimalLongitude", "decimalLatitude", "countryCode", "individualCount", "gbifID", "family",
    "taxonRank", "coordinateUncertaintyInMeters", "year", "basisOfRecord", "institutionCode", "datasetKey",
)

EARTH_RADIUS_M = 6371008.8


def filter_plots(plots: DataFrame, recorded: str = "Plant_recorded", uncertainty: str = "Location_uncertainty",
                 accepted: Sequence[str] = PLOT_RECORDING, limit: float = 1000) -> DataFrame:
    return plots.where(F.col(recorded).isin(*accepted) & (F.col(uncertainty) <= limit))


def project_occurrences(occ: DataFrame, lon: str = "decimalLongitude", lat: str = "decimalLatitude",
                        columns: Sequence[str] = OCCURRENCE_COLUMNS) -> DataFrame:
    """The working columns, coordinates as numbers, rows without coordinates dropped."""
    kept = occ.select(*columns)
    return (
        kept.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
        .withColumns({lon: F.col(lon).try_cast("double"), lat: F.col(lat).try_cast("double")})
    )


def with_country3(occ: DataFrame, codes: DataFrame, column: str = "countryCode") -> DataFrame:
    """Two-letter country code replaced by the three-letter one; null when unknown.

    ``codes`` (iso2, iso3) has one row per country.
    """
    return occ.join(codes.select(F.col("iso2").alias(column), "iso3"), column, "left").drop(column).withColumnRenamed("iso3", column)


# ---- coordinate tests: each returns a column that is true when the record passes ----


def valid_coordinates(lon: str, lat: str) -> Column:
    return F.coalesce(F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90), F.lit(False))


def not_zero(lon: str, lat: str, radius_deg: float = 0.5) -> Column:
    """Neither coordinate exactly 0 and not inside the circle around (0, 0)."""
    near = F.pow(F.col(lon), 2) + F.pow(F.col(lat), 2) <= radius_deg**2
    return ~((F.col(lon) == 0) | (F.col(lat) == 0) | near)


def not_equal(lon: str, lat: str) -> Column:
    return F.abs(F.col(lon)) != F.abs(F.col(lat))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def flag_duplicates(occ: DataFrame, keys: Sequence[str], order: str, name: str = "ok_duplicates") -> DataFrame:
    """False for every record after the first with the same species and coordinates (``order``: a record id).

    Null where a key or the record id is null. Records are sorted once and read in order, so no group of copies is held.
    """
    first = F.first(order, ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return occ.select(*keys, *[c for c in occ.columns if c not in keys], F.when(known, F.col(order) == first).alias(name))


def near_reference(
    locations: DataFrame, points: DataFrame, cell_deg: float = 0.25, lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Distinct coordinates within ``radius_m`` of a reference point (with lon, lat, radius_m).

    Each reference point is copied to the degree cells its radius can reach, also across
    the 180th meridian; each coordinate sits in one cell, and the distance is tested
    inside cells only.
    """
    reach_lat = F.col("radius_m") / 111_000.0
    wide = reach_lat / F.greatest(F.cos(F.radians(F.least(F.lit(89.0), F.abs(F.col("p_lat")) + reach_lat))), F.lit(0.01))
    # a radius that takes in a pole reaches every longitude
    reach_lon = F.when(F.abs(F.col("p_lat")) + reach_lat >= 89, F.lit(180.0)).otherwise(F.least(wide, F.lit(180.0)))
    east = lambda c: F.pmod(c.cast("double") + 180.0, F.lit(360.0))
    last = math.ceil(360.0 / cell_deg) - 1
    p = points.select(F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"), "radius_m")

    def cells(c: Column, reach: Column) -> Column:
        return F.sequence(F.floor((c - reach) / cell_deg), F.floor((c + reach) / cell_deg))

    turns = [F.filter(cells(east(F.col("p_lon")) + turn, reach_lon), lambda x: x.between(0, last)) for turn in (-360.0, 0.0, 360.0)]
    spread = p.withColumn("_cx", F.explode(F.array_distinct(F.concat(*turns)))).withColumn("_cy", F.explode(cells(F.col("p_lat"), reach_lat)))
    places = locations.select(lon, lat).distinct().withColumns({
        "_cx": F.floor(east(F.col(lon)) / cell_deg), "_cy": F.floor(F.col(lat) / cell_deg)})
    hit = haversine_m(F.col(lon), F.col(lat), F.col("p_lon"), F.col("p_lat")) <= F.col("radius_m")
    return places.join(spread, ["_cx", "_cy"]).where(hit).select(lon, lat).distinct()


def flag_near_reference(occ: DataFrame, points: DataFrame, name: str = "ok_reference", **kw) -> DataFrame:
    lon, lat = kw.get("lon", "lon"), kw.get("lat", "lat")
    near = near_reference(occ, points, **kw).withColumn("_hit", F.lit(True))
    return occ.join(near, [lon, lat], "left").withColumn(name, F.col("_hit").isNull()).drop("_hit")


def flag_summary(flagged: DataFrame, flags: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every test, one row with the number of failures per test)."""
    passed = reduce(lambda a, b: a & b, [F.coalesce(F.col(f), F.lit(False)) for f in flags])
    counts = flagged.agg(
        F.count("*").alias("n_records"), F.count_if(passed).alias("n_passed"),
        *[F.count_if(~F.coalesce(F.col(f), F.lit(False))).alias(f"failed_{f.removeprefix('ok_')}") for f in flags],
    )
    return flagged.where(passed), counts


def precise_enough(uncertainty: str = "coordinateUncertaintyInMeters", limit_km: float = 1.0) -> Column:
    """Uncertainty within the limit, or not given."""
    return F.col(uncertainty).isNull() | (F.col(uncertainty) / 1000 <= limit_km)


def accepted_basis(basis: str = "basisOfRecord", accepted: Sequence[str] = RECORD_BASES) -> Column:
    return F.col(basis).isin(*accepted)


# ---- native areas ----


def accepted_native_areas(names: DataFrame, distribution: DataFrame) -> DataFrame:
    """(taxon_name, area_code) of accepted species, native, extant and certain areas only."""
    species = names.where((F.col("taxon_rank") == "Species") & (F.col("taxon_status") == "Accepted"))
    native = distribution.where(
        (F.col("introduced") == 0) & (F.col("extinct") == 0) & (F.col("location_doubtful") == 0))
    return (
        species.select("plant_name_id", "taxon_name")
        .join(native.select("plant_name_id", F.col("area_code_l3").alias("area_code")), "plant_name_id")
        .select("taxon_name", "area_code").distinct()
    )


def split_homonym_areas(ranges: DataFrame, accepted: DataFrame, key: str = "taxon_name") -> tuple[DataFrame, DataFrame]:
    """(areas kept, areas dropped because no accepted name of that spelling has them)."""
    on = [key, "area_code"]
    return ranges.join(accepted, on, "left_semi"), ranges.join(accepted, on, "left_anti")


def quarantine(species: DataFrame, stages: Sequence[tuple[str, DataFrame]], key: str = "species_id") -> DataFrame:
    """Species that are missing from a stage, with the reason of the first stage they miss.

    ``stages`` lists (reason, table of what is left after the stage) in order.
    """
    out = species.select(key).distinct()
    reason = F.lit(None).cast("string")
    for i, (_, left) in enumerate(stages):
        present = left.select(key).distinct().withColumn(f"_s{i}", F.lit(True))
        out = out.join(present, key, "left")
    for i in reversed(range(len(stages))):
        reason = F.when(F.col(f"_s{i}").isNull(), F.lit(stages[i][0])).otherwise(reason)
    return out.select(key, reason.alias("reason")).where(F.col("reason").isNotNull())


# ---- keys and support ----


def skip_existing(todo: DataFrame, done: DataFrame, key: str = "species_id") -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def drop_unmatched(records: DataFrame, unmatched: DataFrame, key: str) -> DataFrame:
    return records.join(unmatched.select(key).distinct(), key, "left_anti")


def min_support(cells: DataFrame, minimum: int = 30, key: str = "species_id") -> DataFrame:
    """Rows of species that have at least ``minimum`` rows."""
    enough = cells.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum).select(key)
    return cells.join(enough, key, "left_semi")


def keep_shared_species(records: DataFrame, other: DataFrame, key: str = "species_id") -> DataFrame:
    """Rows whose key is null or also occurs in ``other``."""
    known = other.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(True))
    return records.join(known, key, "left").where(F.col(key).isNull() | F.col("_known")).drop("_known")


def split_missing_keys(records: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a key, rows without)."""
    return records.where(F.col(key).isNotNull()), records.where(F.col(key).isNull())


def remove_listed(records: DataFrame, removal: DataFrame, key: str) -> DataFrame:
    return records.join(removal.select(key).distinct(), key, "left_anti")


def dedupe_species_location(records: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row, in a stable order, per species and coordinates."""
    return first_per_group(records, keys, order)


def bbox_filter(points: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float,
                lon: str = "lon", lat: str = "lat") -> DataFrame:
    return points.where(F.col(lon).between(min_x, max_x) & F.col(lat).between(min_y, max_y))


def finite_only(df: DataFrame, value: str = "value") -> DataFrame:
    return df.where(finite_or_null(value).isNotNull())


def mask_labels(
    pred: DataFrame, locations: DataFrame, species_area: DataFrame, label: str = "label"
) -> DataFrame:
    """Label null outside the native range and where it was -1.

    The area is looked up once per row; the range itself is the small
    (species, area) table.
    """
    in_range = species_area.select("species_id", "area_code").distinct().withColumn("_in", F.lit(True))
    return (
        pred.join(locations.select("location_id", "area_code"), "location_id")
        .join(in_range, ["species_id", "area_code"], "left")
        .withColumn(label, F.when(F.col("_in") & (F.col(label) >= 0), F.col(label)))
        .drop("_in", "area_code")
    )
