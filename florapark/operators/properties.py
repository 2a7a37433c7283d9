"""Per-species sampling properties and their distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from florapark.functions.scores import finite_or_null
from florapark.operators.ranking import quantiles, running_sum_in_group, value_band

AXES = ("sampling_effort", "relative_prevalence")


def in_range_counts(locations: DataFrame, species_area: DataFrame, name: str) -> DataFrame:
    """Locations inside each species' range.

    Locations are counted per area first; the (location, species) pairs of the mask
    are never formed.
    """
    per_area = locations.groupBy("area_code").agg(F.count("*").alias("_n"))
    return (
        species_area.select("species_id", "area_code").distinct()
        .join(per_area, "area_code", "left")
        .groupBy("species_id").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias(name))
    )


def visited(locations: DataFrame, presence: DataFrame) -> DataFrame:
    """Locations with at least one record of any species."""
    return locations.join(presence.select("location_id").distinct(), "location_id", "left_semi")


def observed(presence: DataFrame, name: str = "n_species_obs") -> DataFrame:
    """Presence rows per species (all rows, as the column sum of the target table)."""
    return presence.groupBy("species_id").agg(F.count("*").alias(name))


def in_range_presence(presence: DataFrame, locations: DataFrame, species_area: DataFrame) -> DataFrame:
    """Presence rows whose location lies in an area of the species' range."""
    placed = presence.join(locations.select("location_id", "area_code"), "location_id")
    return placed.join(species_area, ["species_id", "area_code"], "left_semi")


def train_prevalence(species: DataFrame, presence: DataFrame, locations: DataFrame) -> DataFrame:
    """Positives over all rows, in percent."""
    rows = locations.agg(F.count("*").alias("n")).scalar()
    return (
        species.select("species_id").join(observed(presence, "_pos"), "species_id", "left")
        .select("species_id", F.try_divide(F.coalesce("_pos", F.lit(0)) * 100.0, rows).alias("train_prevalence"))
    )


def test_prevalence(
    species: DataFrame, presence: DataFrame, plots: DataFrame, species_area: DataFrame
) -> DataFrame:
    """Presences over plots in range, in percent; 0 without a plot in range. Also the plot count."""
    base = species.select("species_id")
    n = F.coalesce("num_plots_in_range", F.lit(0)).cast("bigint")
    pos = F.coalesce("_pos", F.lit(0))
    return (
        base.join(observed(in_range_presence(presence, plots, species_area), "_pos"), "species_id", "left")
        .join(in_range_counts(plots, species_area, "num_plots_in_range"), "species_id", "left")
        .select(
            "species_id", n.alias("num_plots_in_range"),
            F.when(n > 0, pos * 100.0 / n).otherwise(0.0).alias("test_prevalence"),
        )
    )


def sampling_properties(
    species: DataFrame, presence: DataFrame, locations: DataFrame, species_area: DataFrame,
    in_range_only: bool = False,
) -> DataFrame:
    """Cells in range, visited cells in range, observed cells, sampling effort, relative prevalence."""
    seen = in_range_presence(presence, locations, species_area) if in_range_only else presence
    joined = (
        species.select("species_id")
        .join(in_range_counts(locations, species_area, "n_cells_in_range"), "species_id", "left")
        .join(in_range_counts(visited(locations, presence), species_area, "n_cells_visited_in_range"), "species_id", "left")
        .join(observed(seen), "species_id", "left")
        .na.fill(0, ["n_cells_in_range", "n_cells_visited_in_range", "n_species_obs"])
    )
    return joined.withColumns({
        "sampling_effort": F.try_divide(F.col("n_cells_visited_in_range") * 100.0, F.col("n_cells_in_range")),
        "relative_prevalence": F.try_divide(F.col("n_species_obs") * 100.0, F.col("n_cells_visited_in_range")),
    })


def property_table(
    table: DataFrame, blocks: dict[str, DataFrame], add_only: bool = True, force: Sequence[str] = ()
) -> tuple[DataFrame, list[str], list[str]]:
    """Join the column blocks that ``table`` lacks; also the names of blocks added and skipped.

    A forced block replaces its old columns, and so does every block if ``add_only`` is off.
    """
    unknown = [f for f in force if f not in blocks]
    if unknown:
        raise ValueError(f"unknown blocks {unknown}; available: {sorted(blocks)}")
    added, skipped = [], []
    for name, block in blocks.items():
        columns = [c for c in block.columns if c != "species_id"]
        if add_only and name not in force and all(c in table.columns for c in columns):
            skipped.append(name)
            continue
        table = table.drop(*columns).join(block, "species_id", "left")
        added.append(name)
    return table, added, skipped


def average_rank(df: DataFrame, values: Sequence[str], names: Sequence[str], key: str = "species_id") -> DataFrame:
    """Average rank of ties divided by the number of ranked rows, times 100, for each of the values.

    Equal values merge before they are ordered, and all columns are ranked in one pass.
    """
    tall = df.select(key, F.posexplode(F.array(*[finite_or_null(v) for v in values])).alias("_axis", "_v")).where(
        F.col("_v").isNotNull())
    ties = tall.groupBy("_axis", "_v").agg(F.count("*").alias("_n"))
    total = ties.groupBy("_axis").agg(F.sum("_n").alias("_total"))
    upto = running_sum_in_group(ties, ["_axis"], value_band("_v"), ["_v"], F.col("_n"), "_upto").join(total, "_axis")
    # ties fill the ranks upto - n + 1 to upto
    share = upto.select("_axis", "_v", ((F.col("_upto") - (F.col("_n") - 1) / 2) * 100.0 / F.col("_total")).alias("_pct"))
    wide = tall.join(share, ["_axis", "_v"]).groupBy(key).agg(
        *[F.max(F.when(F.col("_axis") == i, F.col("_pct"))).alias(n) for i, n in enumerate(names)])
    return df.join(wide, key, "left")


def species_percentiles(properties: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    """Raw value and average-rank percentile of each axis."""
    return average_rank(properties.select("species_id", *axes), axes, [f"{a}_percentile" for a in axes])


LEVELS = ("full", "aggregated")


def occurrence_counts(levels: dict[str, DataFrame]) -> DataFrame:
    """Records per (level, species); a level is ``full``, ``aggregated`` or ``subsampled_N``."""
    wrong = [n for n in levels if n not in LEVELS and not (n.startswith("subsampled_") and n[11:].isdigit())]
    if wrong:
        raise ValueError(f"unknown levels {wrong}; use 'full', 'aggregated' or 'subsampled_N'")
    tall = None
    for name, table in levels.items():
        part = table.groupBy("species_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("level"), "species_id", "n")
        tall = part if tall is None else tall.unionByName(part)
    return tall


def _linear_bin(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """0-based bin of n equal bins, the last edge belonging to the last bin."""
    step = F.try_divide(v - lo, hi - lo) * n
    return F.least(F.lit(n - 1), F.floor(step)).cast("int")


def occurrence_histogram(counts: DataFrame, edges: int = 50, scale: str = "linear") -> DataFrame:
    """Species per occurrence-count bin and level; zero counts are dropped."""
    if scale not in ("linear", "log"):
        raise ValueError("scale must be 'linear' or 'log'")
    positive = counts.where(F.col("n") > 0)
    top = positive.groupBy("level").agg(F.max("n").alias("_hi"))
    n = F.col("n").cast("double")
    hi = F.col("_hi").cast("double")
    if scale == "log":
        bin_no = _linear_bin(F.log10(n), F.lit(0.0), F.log10(hi), edges - 1)
    else:
        bin_no = _linear_bin(n, F.lit(0.0), hi, edges - 1)
    return (
        positive.join(top, "level").groupBy("level", F.coalesce(bin_no, F.lit(0)).alias("bin"))
        .agg(F.count("*").alias("n_species"))
    )


def histogram_2d(df: DataFrame, x: Column, y: Column, bins: int) -> DataFrame:
    """Counts per (x_bin, y_bin) plus both marginals (the other bin null) and the total."""
    return (
        df.select(x.alias("x_bin"), y.alias("y_bin"))
        .groupingSets([["x_bin", "y_bin"], ["x_bin"], ["y_bin"], []], "x_bin", "y_bin")
        .agg(F.count("*").alias("n"), F.grouping_id().alias("part"))
    )


def property_histogram_raw(properties: DataFrame, x: str = AXES[0], y: str = AXES[1], bins: int = 40) -> DataFrame:
    """Two-dimensional histogram with log-spaced bins between the extremes."""
    usable = properties.where((F.col(x) > 0) & (F.col(y) > 0))
    ends = usable.agg(F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).alias("e"))
    e = usable.withColumn("_e", ends.scalar())

    def log_bin(v: str, lo: str, hi: str) -> Column:
        return _linear_bin(F.log10(v), F.log10(F.col(f"_e.{lo}")), F.log10(F.col(f"_e.{hi}")), bins)

    return histogram_2d(e, log_bin(x, "x0", "x1"), log_bin(y, "y0", "y1"), bins)


def property_histogram_percentile(properties: DataFrame, x: str = AXES[0], y: str = AXES[1], bins: int = 40) -> DataFrame:
    """Two-dimensional histogram of average-rank percentiles, equal bins over 0 to 100."""
    p = species_percentiles(properties, (x, y))
    p = p.where(F.col(f"{x}_percentile").isNotNull() & F.col(f"{y}_percentile").isNotNull())

    def pct_bin(v: str) -> Column:
        return _linear_bin(F.col(f"{v}_percentile"), F.lit(0.0), F.lit(100.0), bins)

    return histogram_2d(p, pct_bin(x), pct_bin(y), bins)


def reference_quantiles(properties: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    """10 % and 50 % quantile of each axis, linear interpolation."""
    tall = None
    for axis in axes:
        row = quantiles(properties.withColumn(axis, finite_or_null(axis)), axis, [0.1, 0.5], ["q10", "q50"])
        row = row.select(F.lit(axis).alias("axis"), "q10", "q50")
        tall = row if tall is None else tall.unionByName(row)
    return tall


def region_counts(member: DataFrame) -> DataFrame:
    """Species per stratum."""
    return member.groupBy("region").agg(F.count_distinct("species_id").alias("n_species"))
