"""Snapping records, predictors and plots to grid cells; regular map grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from florapark.functions import projection as P
from florapark.operators.ranking import global_index

EARTH_RADIUS_KM = 6371.0


def with_cell(df: DataFrame, lon: str = "lon", lat: str = "lat", res: float = 1000.0) -> DataFrame:
    return df.withColumns({"gx": P.grid_x(lon, res), "gy": P.grid_y(lat, res)})


def with_cell_centre(df: DataFrame, res: float = 1000.0) -> DataFrame:
    return df.withColumns({"lon": P.centre_lon("gx", res), "lat": P.centre_lat("gy", res)})


def aggregate_presence(locations: DataFrame, presence: DataFrame) -> DataFrame:
    """(gx, gy, species_id): a cell is present if any of its records is."""
    cells = with_cell(locations).select("location_id", "gx", "gy")
    return presence.join(cells, "location_id").select("gx", "gy", "species_id").distinct()


def reduction(locations: DataFrame, presence: DataFrame) -> DataFrame:
    """Rows and presences before and after gridding, with the reduction in percent."""
    cells = with_cell(locations).select("gx", "gy").distinct().agg(F.count("*").alias("n")).scalar()
    after = aggregate_presence(locations, presence).agg(F.count("*").alias("n")).scalar()
    before = presence.distinct().agg(F.count("*").alias("n")).scalar()
    out = locations.agg(F.count("*").alias("rows_before")).select(
        "rows_before", cells.alias("rows_after"), before.alias("presences_before"), after.alias("presences_after"))
    return out.withColumn(
        "row_reduction_percent",
        F.try_divide((F.col("rows_before") - F.col("rows_after")) * 100.0, F.col("rows_before")))


def mean_per_cell(df: DataFrame, columns: Sequence[str], skip_null: bool = False, keys: Sequence[str] = ("gx", "gy")) -> DataFrame:
    """Mean of each column per cell. Unless ``skip_null``, one missing input makes the cell missing."""
    means = [
        (F.avg(c) if skip_null else F.when(F.count(c) == F.count("*"), F.avg(c))).alias(c) for c in columns
    ]
    return df.groupBy(*keys).agg(*means)


def snap_to_reference_grid(df: DataFrame, columns: Sequence[str], reference: DataFrame) -> DataFrame:
    """Mean per cell of a fixed grid, missing inputs skipped; every reference cell appears once."""
    means = mean_per_cell(df, columns, skip_null=True)
    return reference.select("gx", "gy").distinct().join(means, ["gx", "gy"], "left")


def snap_report(df: DataFrame, columns: Sequence[str], reference: DataFrame) -> DataFrame:
    """Input rows off the reference grid, reference cells without any value, all reference cells."""
    cells = reference.select("gx", "gy").distinct()
    orphans = df.join(cells, ["gx", "gy"], "left_anti").agg(F.count("*").alias("n")).scalar()
    empty = F.lit(True)
    for c in columns:
        empty = empty & F.col(c).isNull()
    snapped = snap_to_reference_grid(df, columns, reference)
    return snapped.agg(F.count("*").alias("n_cells"), F.count_if(empty).alias("n_empty_cells")).withColumn("n_orphans", orphans)


def one_record_per_species_cell(records: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """First non-null value of each column per (species, cell); coordinates become the cell centre."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return with_cell_centre(with_cell(records).groupBy("species_id", "gx", "gy").agg(*firsts))


def recover_empty_cells(all_cells: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept (species, cell) rows plus one row with null species per cell that lost all of them."""
    lost = all_cells.select("gx", "gy").distinct().join(kept.select("gx", "gy").distinct(), ["gx", "gy"], "left_anti")
    return kept.select("species_id", "gx", "gy").unionByName(
        lost.select(F.lit(None).cast("bigint").alias("species_id"), "gx", "gy"))


def sampled_area(plots: DataFrame, cells: DataFrame, plot: str = "location_id", area: str = "sampled_area_m2") -> DataFrame:
    """Sum of plot areas per cell, each plot once; missing if no plot of the cell has one."""
    once = plots.groupBy(plot, "gx", "gy").agg(F.max(area).alias(area))
    total = once.groupBy("gx", "gy").agg(F.sum(area).alias(area))
    return cells.select("gx", "gy").distinct().join(total, ["gx", "gy"], "left")


def unique_locations(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Distinct coordinates, numbered in (lon, lat) order."""
    return global_index(df.select(lon, lat).distinct(), [lon, lat], "location_id")


def lattice_size(spacing_km: float = 5.0) -> int:
    import math

    return int(4 * math.pi * EARTH_RADIUS_KM**2 / spacing_km**2)


def background_points(spark, n: int) -> DataFrame:
    """``n`` points evenly spread over the sphere along a golden-angle spiral; a pole has longitude 0."""
    import math

    i = F.col("id").cast("double")
    y = 1 - i * 2 / (n - 1)
    r = F.sqrt(1 - y * y)
    theta = F.lit(math.pi * (3 - math.sqrt(5))) * i
    return spark.range(n).select(
        F.col("id").alias("point_id"),
        F.degrees(F.atan2(F.sin(theta) * r, F.cos(theta) * r)).alias("lon"),
        F.degrees(F.asin(y)).alias("lat"),
    )


def crop_bounds(points: DataFrame, pad: float = 0.05, clip: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Bounding box widened on each side by ``pad`` times its extent, kept on the globe unless ``clip`` is off."""
    x0, x1, y0, y1 = F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")
    px, py = (x1 - x0) * pad, (y1 - y0) * pad
    box = {"min_x": x0 - px, "min_y": y0 - py, "max_x": x1 + px, "max_y": y1 + py}
    if clip:
        box = {
            "min_x": F.greatest(F.lit(-180.0), box["min_x"]), "min_y": F.greatest(F.lit(-90.0), box["min_y"]),
            "max_x": F.least(F.lit(180.0), box["max_x"]), "max_y": F.least(F.lit(90.0), box["max_y"]),
        }
    return points.groupBy(*keys).agg(*[c.alias(k) for k, c in box.items()])


def regular_grid(bounds: DataFrame, res: float, keys: Sequence[str] = ()) -> DataFrame:
    """Cells of a map: longitude rising, latitude falling, half a cell of tolerance at the far ends.

    ``bounds`` has one row (per key) with min_x, min_y, max_x, max_y.
    """
    def last_step(extent: Column) -> Column:
        # as many steps as stay below extent + res / 2
        return F.greatest(F.lit(0).cast("bigint"), F.ceil((extent + res * 0.5) / res) - 1)

    sized = bounds.withColumns({
        "_w": last_step(F.col("max_x") - F.col("min_x")), "_h": last_step(F.col("max_y") - F.col("min_y"))})
    rows = sized.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_h"))).alias("row"))
    # rows are spread over tasks before each is opened into its columns
    rows = rows.repartition(*[F.col(k) for k in keys], F.col("row"))
    cells = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_w"))).alias("col"))
    return cells.select(
        *keys, "row", "col", (F.col("row") * (F.col("_w") + 1) + F.col("col")).alias("flat_index"),
        (F.col("min_x") + F.col("col") * res).alias("lon"), (F.col("max_y") - F.col("row") * res).alias("lat"),
    )


def to_map_cells(predictions: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """Predictions by flat index as (row, col, value) over the whole map, other cells null."""
    one = predictions.sparkSession.range(1)
    w, h = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    cells = (
        one.select(F.explode(F.sequence(F.lit(0).cast("bigint"), h.cast("bigint") - 1)).alias("row"), w.cast("bigint").alias("_w"))
        .repartition("row")
        .select("row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_w") - 1)).alias("col"), "_w")
        .select("row", "col", (F.col("row") * F.col("_w") + F.col("col")).alias("flat_index"))
    )
    return cells.join(predictions.select("flat_index", "value"), "flat_index", "left")
