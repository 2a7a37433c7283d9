"""Tables behind maps: nearest predictors on a grid, rescaling, occurrence grids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from florapark.functions.scores import finite_or_null, score_band
from florapark.session import pin
from florapark.operators.ranking import running_sum_in_group, weighted_quantiles

LOG_FLOOR = 1e-12  # fixed value: smallest prediction told apart on the log scale
LAND_STEPS = 1.5  # fixed value: cells farther than this many steps from any background point are sea

# fixed values: named boxes (lon_min, lon_max, lat_min, lat_max)
REGION_BOXES = {
    "europe": (-10, 35, 34, 72),
    "australia": (110, 155, -45, -10),
    "north_america": (-170, -50, 15, 75),
    "south_america": (-85, -30, -60, 15),
    "africa": (-20, 55, -40, 40),
    "asia": (25, 140, -10, 75),
}


def nearest_background(background: DataFrame, bounds: DataFrame, res: float, keys: Sequence[str] = ()) -> DataFrame:
    """Grid cells on land with their nearest background point (ties to the smaller point id).

    The grid is regular, so every background point can name the few cells within reach
    itself; the nearest point is then a plain aggregate per cell. ``bounds`` has one
    row, or one small row per key when ``keys`` are given and present in both inputs.
    """
    limit = LAND_STEPS * res
    box = bounds.select(F.struct("min_x", "min_y", "max_x", "max_y").alias("_b"), *keys)
    placed = background.join(box, list(keys)) if keys else background.withColumn("_b", box.select("_b").scalar())
    x, y = F.col("lon"), F.col("lat")
    inside = x.between(F.col("_b.min_x"), F.col("_b.max_x")) & y.between(F.col("_b.min_y"), F.col("_b.max_y"))
    cropped = placed.where(inside).groupBy(*keys, "lon", "lat", "_b").agg(F.min("point_id").alias("point_id"))

    def last(extent: Column) -> Column:
        return F.greatest(F.lit(0).cast("bigint"), F.ceil((extent + res * 0.5) / res) - 1)

    w, h = last(F.col("_b.max_x") - F.col("_b.min_x")), last(F.col("_b.max_y") - F.col("_b.min_y"))

    def reach(offset: Column, top: Column) -> Column:
        lo = F.greatest(F.lit(0).cast("bigint"), F.floor(offset - LAND_STEPS))
        hi = F.least(top, F.ceil(offset + LAND_STEPS))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    cells = (
        cropped.withColumn("_w", w)
        .withColumn("row", F.explode(reach((F.col("_b.max_y") - y) / res, h)))
        .withColumn("col", F.explode(reach((x - F.col("_b.min_x")) / res, w)))
        .withColumns({"_gx": F.col("_b.min_x") + F.col("col") * res, "_gy": F.col("_b.max_y") - F.col("row") * res})
        .withColumn("_d", F.sqrt(F.pow(F.col("_gx") - x, 2) + F.pow(F.col("_gy") - y, 2)))
        .where(F.col("_d") <= limit)
    )
    return (
        cells.groupBy(*keys, "row", "col")
        .agg(F.min(F.struct("_d", "point_id", "_gx", "_gy", "_w")).alias("b"))
        .select(*keys, "row", "col", (F.col("row") * (F.col("b._w") + 1) + F.col("col")).alias("flat_index"),
                F.col("b._gx").alias("lon"), F.col("b._gy").alias("lat"), F.col("b.point_id").alias("point_id"))
    )


def mask_to_range(cells: DataFrame, species_area: DataFrame, value: str = "value") -> DataFrame:
    """Value null in areas outside the species' range (cells: species_id, area_code, value)."""
    pairs = species_area.select("species_id", "area_code").distinct().withColumn("_in", F.lit(True))
    return cells.join(pairs, ["species_id", "area_code"], "left").withColumn(
        value, F.when(F.col("_in"), F.col(value))).drop("_in")


# ---- rescaling for display ----


def _ties(cells: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(keys, _v, _c): each distinct value with how often it counts.

    In-range cells count; on a map without any, all cells do. Everything after this
    works on distinct values.
    """
    merged = cells.groupBy(*keys, value.alias("_v")).agg(
        F.count_if("in_range").alias("_in"), F.count("*").alias("_all"))
    some = merged.groupBy(*keys).agg((F.sum("_in") > 0).alias("_some"))
    return merged.join(some, list(keys)).select(
        *keys, "_v", F.when(F.col("_some"), F.col("_in")).otherwise(F.col("_all")).alias("_c"))


def _log(value: Column) -> Column:
    return F.log10(F.greatest(value, F.lit(LOG_FLOOR)))


def _check_mode(mode: str) -> None:
    if mode not in ("none", "linear", "log", "rank"):
        raise ValueError(f"unknown rescale mode {mode!r}; use 'none', 'linear', 'log' or 'rank'")


def _stretch(ties: DataFrame, keys: Sequence[str], mode: str, low_q: float, high_q: float) -> DataFrame:
    """(keys, lo, hi) from counted values; the extremes where the percentiles coincide."""
    slices = score_band("_v") if mode == "linear" else F.floor(F.col("_v") * 64)
    q = weighted_quantiles(ties, keys, "_v", "_c", slices, [low_q / 100, high_q / 100], ["lo", "hi"])
    used = ties.where((F.col("_c") > 0) & F.col("_v").isNotNull())
    ends = used.groupBy(*keys).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    flat = F.col("hi") <= F.col("lo")
    return q.join(ends, list(keys)).select(
        *keys, F.when(flat, F.col("_min")).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("_max")).otherwise(F.col("hi")).alias("hi"))


def _on_scale(mode: str, value: str) -> Column:
    v = finite_or_null(value)
    return F.when(v.isNotNull(), _log(v)) if mode == "log" else v


def rescale_reference(
    cells: DataFrame, keys: Sequence[str] = ("species_id",), mode: str = "linear",
    low_q: float = 10.0, high_q: float = 90.0, value: str = "value",
) -> DataFrame:
    """(keys, lo, hi) of the percentile stretch taken from in-range cells (in log10 for mode ``log``)."""
    _check_mode(mode)
    return _stretch(_ties(cells, keys, _on_scale(mode, value)), keys, mode, low_q, high_q)


def apply_reference(
    cells: DataFrame, reference: DataFrame, keys: Sequence[str] = ("species_id",), mode: str = "linear",
    gamma: float = 1.0, value: str = "value",
) -> DataFrame:
    """Adds ``scaled`` in [0, 1]; 0 where the reference has no width."""
    v = _on_scale(mode, value)
    width = F.col("hi") - F.col("lo")
    scaled = F.when(width > 0, (v - F.col("lo")) / width).otherwise(F.when(v.isNotNull(), 0.0))
    return cells.join(reference, list(keys)).withColumn("scaled", _finish(scaled, gamma)).drop("lo", "hi")


def _finish(scaled: Column, gamma: float) -> Column:
    unit = F.when(scaled.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))
    return unit if gamma == 1.0 else F.pow(unit, F.lit(gamma))


def rank_rescale(cells: DataFrame, keys: Sequence[str] = ("species_id",), gamma: float = 1.0, value: str = "value") -> DataFrame:
    """Share of in-range values that are not larger, for every cell."""
    ties = _ties(cells, keys, F.col(value))
    upto = running_sum_in_group(ties, keys, score_band("_v"), ["_v"], F.col("_c"), "_upto")
    total = ties.groupBy(*keys).agg(F.sum("_c").alias("_total"))
    share = upto.join(total, list(keys)).select(
        *keys, F.col("_v").alias(value), F.try_divide(F.col("_upto").cast("double"), F.col("_total")).alias("_s"))
    return cells.join(share, [*keys, value], "left").withColumn("scaled", _finish(F.col("_s"), gamma)).drop("_s")


def rescale(
    cells: DataFrame, mode: str = "linear", low_q: float = 10.0, high_q: float = 90.0, gamma: float = 1.0,
    keys: Sequence[str] = ("species_id",), value: str = "value", reference: DataFrame | None = None,
) -> DataFrame:
    """Predictions of each map stretched to [0, 1]. ``cells`` has keys, value, in_range.

    A given ``reference`` (see ``shared_reference``) replaces the map's own.
    """
    _check_mode(mode)
    if mode == "none":
        return cells.withColumn("scaled", _finish(finite_or_null(value), gamma))
    if mode == "rank":
        return rank_rescale(cells, keys, gamma, value)
    if reference is None:
        reference = rescale_reference(cells, keys, mode, low_q, high_q, value)
    return apply_reference(cells, reference, keys, mode, gamma, value)


def shared_reference(
    maps: Sequence[DataFrame], mode: str = "linear", low_q: float = 10.0, high_q: float = 90.0,
    keys: Sequence[str] = ("species_id",), value: str = "value",
) -> DataFrame:
    """One stretch per species from the pooled in-range predictions of several models."""
    _check_mode(mode)
    pool = reduce(DataFrame.unionByName, [_ties(m, keys, _on_scale(mode, value)) for m in maps])
    merged = pool.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
    return _stretch(merged, keys, mode, low_q, high_q)


# ---- occurrence grids and regions ----


def _median_gap(places: DataFrame, axis: str, keys: Sequence[str]) -> DataFrame:
    """Median distance between neighbouring distinct values; at most one value per grid column or row."""
    w = Window.partitionBy(*keys).orderBy(axis)
    gaps = places.select(*keys, axis).distinct().withColumn("_gap", F.col(axis) - F.lag(axis).over(w))
    return gaps.groupBy(*keys).agg(F.coalesce(F.percentile("_gap", F.lit(0.5)), F.lit(0.008333)).alias(f"_step_{axis}"))


def occurrence_grid(in_range: DataFrame, presence: DataFrame, keys: Sequence[str] = ("species_id",),
                    max_dim: int | None = None) -> DataFrame:
    """(keys, row, col, category, step): 0 visited, 1 present. The step is the data's own spacing.

    With ``max_dim`` the step grows until the grid has at most so many rows or columns.

    ``in_range`` and ``presence`` have keys, lon, lat of grid cells.
    """
    keys = list(keys)
    places = in_range.select(*keys, "lon", "lat").distinct()
    extent = places.groupBy(*keys).agg(
        F.min("lon").alias("_x0"), F.min("lat").alias("_y0"),
        F.greatest(F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat")).alias("_span"))
    step = F.greatest("_step_lon", "_step_lat", F.lit(1e-6))
    frame = (
        extent.join(_median_gap(places, "lon", keys), keys).join(_median_gap(places, "lat", keys), keys)
        .withColumn("_step", step if max_dim is None else F.greatest(step, F.greatest("_span", step) / max_dim))
        .select(*keys, "_x0", "_y0", "_step")
    )

    def cells(points: DataFrame, category: int) -> DataFrame:
        return points.join(frame, keys).select(
            *keys, F.rint((F.col("lat") - F.col("_y0")) / F.col("_step")).cast("bigint").alias("row"),
            F.rint((F.col("lon") - F.col("_x0")) / F.col("_step")).cast("bigint").alias("col"), F.lit(category).alias("category"))

    visited = cells(places, 0)
    limits = visited.groupBy(*keys).agg(F.max("row").alias("_rows"), F.max("col").alias("_cols"))
    present = (
        cells(presence.select(*keys, "lon", "lat").distinct(), 1).join(limits, keys)
        .where(F.col("row").between(0, F.col("_rows")) & F.col("col").between(0, F.col("_cols")))
        .drop("_rows", "_cols")
    )
    cells_of = visited.unionByName(present).groupBy(*keys, "row", "col").agg(F.max("category").alias("category"))
    return cells_of.join(frame.select(*keys, F.col("_step").alias("step")), keys)


def range_grids(locations: DataFrame, species_area: DataFrame, presence: DataFrame, max_dim: int | None = None) -> DataFrame:
    """``occurrence_grid`` of every species over the locations of its range and its presences there.

    Species of the same areas share their grid of visited cells, so it is worked out once per
    such set of areas, from the distinct coordinates of an area, and met by the species at the end.
    """
    ranges = pin(species_area.groupBy("species_id").agg(F.array_sort(F.collect_set("area_code")).alias("areas")))
    kinds = ranges.select(F.col("areas").alias("range_id")).distinct()
    places = locations.where(F.col("area_code").isNotNull()).select("area_code", "lon", "lat").distinct()
    visited = kinds.select("range_id", F.explode("range_id").alias("area_code")).join(places, "area_code").select("range_id", "lon", "lat")
    none = visited.where(F.lit(False))
    grid = pin(occurrence_grid(visited, none, ["range_id"], max_dim))
    frame = visited.groupBy("range_id").agg(F.min("lon").alias("_x0"), F.min("lat").alias("_y0")).join(
        grid.select("range_id", "step").distinct(), "range_id")
    seen = (
        presence.select("species_id", "location_id").join(locations.select("location_id", "area_code", "lon", "lat"), "location_id")
        .join(ranges, "species_id").where(F.array_contains("areas", F.col("area_code"))).select("species_id", F.col("areas").alias("range_id"), "lon", "lat").distinct()
        .join(frame, "range_id")
    )
    # a presence in range stands on a visited cell
    present = seen.groupBy("species_id", F.rint((F.col("lat") - F.col("_y0")) / F.col("step")).cast("bigint").alias("row")).agg(
        F.collect_set(F.rint((F.col("lon") - F.col("_x0")) / F.col("step")).cast("bigint")).alias("_cols"))
    lines = grid.groupBy("range_id", "row", "step").agg(F.collect_list("col").alias("_all"))
    met = ranges.select("species_id", F.col("areas").alias("range_id")).join(lines, "range_id").join(present, ["species_id", "row"], "left")
    return met.select("species_id", "row", F.explode("_all").alias("col"), "_cols", "step").select(
        "species_id", "row", "col", F.coalesce(F.array_contains("_cols", F.col("col")), F.lit(False)).cast("int").alias("category"), "step")


def pick_region(points: DataFrame, keys: Sequence[str] = ("species_id",)) -> DataFrame:
    """The named box that holds most points of each group; the first one on ties."""
    counts = {}
    for name, (x0, x1, y0, y1) in REGION_BOXES.items():
        counts[name] = F.count_if(F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1))
    per_group = points.groupBy(*keys).agg(*[c.alias(n) for n, c in counts.items()])
    top = F.greatest(*REGION_BOXES)
    choice = F.coalesce(*[F.when(F.col(n) == top, F.lit(n)) for n in REGION_BOXES])
    return per_group.select(*keys, choice.alias("region"), top.alias("n_points"))
