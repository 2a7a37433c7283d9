"""Ranks of species on two property axes, the eight strata, and deltas inside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from florapark.functions.scores import finite_or_null
from florapark.operators.ranking import group_median, rank_in_group, value_band
from florapark.session import pin

DEFAULT_X = "sampling_effort"
DEFAULT_Y = "relative_prevalence"

# fixed values: (low, high) names of known axes
AXIS_LABELS = {
    "sampling_effort": ("sparse", "dense"),
    "relative_prevalence": ("infrequent", "frequent"),
    "test_prevalence": ("infrequent", "frequent"),
    "train_prevalence": ("infrequent", "frequent"),
    "range_size_km2": ("small-range", "wide-range"),
    "n_cells_in_range": ("small-range", "wide-range"),
}

# fixed values: names of the regions in the order of the report
REGIONS = (
    "bottom_left", "top_left", "bottom_right", "top_right",
    "L3_left_lower", "L4_left_upper", "L1_bottom_left", "L2_bottom_right",
)


def axis_labels(column: str) -> tuple[str, str]:
    return AXIS_LABELS.get(column, ("low", "high"))


def ordinal_ranks(properties: DataFrame, x: str = DEFAULT_X, y: str = DEFAULT_Y, key: str = "species_id") -> DataFrame:
    """1-based ranks on both axes, ties by key; species without both values are left out.

    Both axes are ranked in one pass, inside bands of values that are shifted by the sizes
    of the lower bands. Columns: key, x_rank, y_rank, n_species (how many were ranked).
    """
    usable = (
        properties.select(key, finite_or_null(x).alias("_x"), finite_or_null(y).alias("_y"))
        .where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    )
    both = usable.select(key, F.explode(F.array(
        F.struct(F.lit(0).alias("_axis"), F.col("_x").alias("_v")),
        F.struct(F.lit(1).alias("_axis"), F.col("_y").alias("_v")))).alias("_p")).select(key, "_p.*")
    ranked = rank_in_group(both, ["_axis"], value_band("_v"), ["_v", key], "_rank")
    n = usable.agg(F.count("*").alias("n")).scalar()
    return ranked.groupBy(key).agg(
        F.max(F.when(F.col("_axis") == 0, F.col("_rank"))).alias("x_rank"),
        F.max(F.when(F.col("_axis") == 1, F.col("_rank"))).alias("y_rank"),
    ).withColumn("n_species", n)


def region_names(x: Column, y: Column, n: Column, decile: int = 10) -> Column:
    """Array of the strata a species belongs to: one median quadrant, up to two extreme strips."""
    half, tail = F.floor(n / F.lit(2)), F.floor(n / F.lit(decile))
    left, low = x <= half, y <= half
    far_left, far_low = x <= tail, y <= tail
    corner = far_left & far_low
    named = {
        "bottom_left": left & low,
        "top_left": left & ~low,
        "bottom_right": ~left & low,
        "top_right": ~left & ~low,
        "L3_left_lower": far_left & low & ~(corner & (x >= y)),
        "L4_left_upper": far_left & ~low,
        "L1_bottom_left": far_low & left & ~(corner & (x < y)),
        "L2_bottom_right": far_low & ~left,
    }
    return F.array_compact(F.array(*[F.when(named[r], F.lit(r)) for r in REGIONS]))


def regions(ranks: DataFrame, decile: int = 10, key: str = "species_id") -> DataFrame:
    """One row per (species, stratum)."""
    names = region_names(F.col("x_rank"), F.col("y_rank"), F.col("n_species"), decile)
    return ranks.select(key, F.explode(names).alias("region"))


def region_titles(x: str, y: str, extreme_pct: float) -> dict[str, str]:
    decile = decile_of(extreme_pct)
    lo = round(100.0 / decile)
    (xl, xh), (yl, yh) = axis_labels(x), axis_labels(y)
    return {
        "bottom_left": f"{xl}-{yl}", "top_left": f"{xl}-{yh}",
        "bottom_right": f"{xh}-{yl}", "top_right": f"{xh}-{yh}",
        "L3_left_lower": f"{xl}(p{lo}) x {yl}-half", "L4_left_upper": f"{xl}(p{lo}) x {yh}-half",
        "L1_bottom_left": f"{yl}(p{lo}) x {xl}-half", "L2_bottom_right": f"{yl}(p{lo}) x {xh}-half",
    }


def decile_of(extreme_pct: float) -> int:
    return max(2, round(100.0 / extreme_pct)) if extreme_pct else 10


def stratified_report(
    metrics: DataFrame,
    properties: DataFrame,
    x: str = DEFAULT_X,
    y: str = DEFAULT_Y,
    reference: DataFrame | None = None,
    extreme_pct: float = 10.0,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Mean score, or mean paired delta, in percent per stratum and metric.

    ``metrics`` and ``reference`` are long (species_id, metric, value). Every stratum
    appears for every metric, with n = 0 when no species in it has a finite value.
    Giving the metric ``names`` saves a pass over the metrics to find them.
    """
    spark = metrics.sparkSession
    missing = [c for c in (x, y) if c not in properties.columns]
    if missing:
        text = f"[stratified] property '{missing[0]}' not available; skipping stratified report."
        return spark.createDataFrame([(text,)], "message string")
    value = metrics.select("species_id", "metric", finite_or_null("value").alias("value"))
    if reference is not None:
        ref = reference.select("species_id", "metric", finite_or_null("value").alias("_ref"))
        value = value.join(ref, ["species_id", "metric"], "left").withColumn("value", F.col("value") - F.col("_ref"))
    member = regions(ordinal_ranks(properties, x, y), decile_of(extreme_pct))
    scored = (
        member.join(value, "species_id").groupBy("region", "metric")
        .agg((F.avg("value") * 100).alias("score"), F.count("value").alias("n"))
    )
    titles = region_titles(x, y, extreme_pct)
    # eight fixed strata for each metric name
    if names is None:
        found = value.select("metric").distinct()
    else:
        found = spark.createDataFrame([(n,) for n in names], "metric string")
    frame = found.select(
        "metric",
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("position"), F.lit(r).alias("region"), F.lit(titles[r]).alias("stratum"))
            for i, r in enumerate(REGIONS)
        ])).alias("r"),
    ).select("metric", "r.*")
    return (
        frame.join(scored, ["region", "metric"], "left")
        .select("position", "region", "stratum", "metric", "score", F.coalesce("n", F.lit(0)).alias("n"))
    )


def report_text(report: DataFrame, title: str) -> str:
    """The report as a small text table; eight rows per metric reach the driver."""
    rows = report.orderBy("position", "metric").collect()
    names = sorted({r["metric"] for r in rows})
    by = {(r["position"], r["metric"]): r for r in rows}
    lines = [title, f"  {'stratum':<34}{'n':>8}  " + "".join(f"{m:>12}" for m in names)]
    for pos in sorted({r["position"] for r in rows}):
        group = [by[(pos, m)] for m in names]
        cells = "".join(f"{'nan' if r['score'] is None else format(r['score'], '.2f'):>12}" for r in group)
        lines.append(f"  {group[0]['stratum']:<34}{max(r['n'] for r in group):>8}  {cells}")
    return "\n".join(lines)


def paired(m1: DataFrame, m2: DataFrame, keys: Sequence[str] = ("species_id",)) -> DataFrame:
    """Species that both models score finitely, on the percent scale."""
    a = m1.select(*keys, (finite_or_null("value") * 100).alias("v1")).where("v1 is not null")
    b = m2.select(*keys, (finite_or_null("value") * 100).alias("v2")).where("v2 is not null")
    return a.join(b, list(keys))


AGGREGATES = ("mean", "median", "paired_median")


def grouped_deltas(pairs: DataFrame, keys: Sequence[str], agg: str) -> DataFrame:
    """(keys, n, delta): mean, difference of medians, or median of differences of the pairs in each group."""
    if agg not in AGGREGATES:
        raise ValueError(f"agg must be one of {AGGREGATES}")
    keys = list(keys)
    if agg != "mean":
        pairs = pin(pairs.select(*keys, "v1", "v2"))  # one row per species, used several times
    means = pairs.groupBy(*keys).agg(F.count("*").alias("n"), (F.avg("v2") - F.avg("v1")).alias("delta"))
    if agg == "mean":
        return means
    if agg == "paired_median":
        middle = group_median(pairs.withColumn("_d", F.col("v2") - F.col("v1")), keys, "_d", "delta")
    else:
        middle = group_median(pairs, keys, "v1", "_m1").join(group_median(pairs, keys, "v2", "_m2"), keys).select(
            *keys, (F.col("_m2") - F.col("_m1")).alias("delta"))
    return means.drop("delta").join(middle, keys)


def _all_regions(df: DataFrame) -> DataFrame:
    names = df.sparkSession.createDataFrame([(r,) for r in REGIONS], "region string")
    return (
        F.broadcast(names).join(df, "region", "left")  # eight rows
        .select("region", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("delta", F.lit(0.0)).alias("delta"))
    )


def region_deltas(member: DataFrame, pairs: DataFrame, agg: str = "mean") -> DataFrame:
    """Per stratum: number of paired species and delta in points; 0 when empty."""
    return _all_regions(grouped_deltas(member.join(pairs, "species_id"), ["region"], agg))


def seed_stacked_deltas(member: DataFrame, pairs: DataFrame, n_seeds: int, agg: str = "median") -> DataFrame:
    """As ``region_deltas`` with seeds: species finite in every seed, reduced per seed, then averaged."""
    complete = pairs.groupBy("species_id").agg(F.count_distinct("seed").alias("k")).where(F.col("k") == n_seeds)
    inside = member.join(pairs.join(complete, "species_id", "left_semi"), "species_id")
    per_seed = grouped_deltas(inside, ["region", "seed"], agg)
    return _all_regions(per_seed.groupBy("region").agg(F.max("n").alias("n"), F.avg("delta").alias("delta")))


def moving_window_grid(ranks: DataFrame, pairs: DataFrame, window: int, shift: int, agg: str = "mean") -> DataFrame:
    """Delta per (x_step, y_step) over species whose ranks lie in the half-open window around both steps.

    Each species is sent to exactly the steps that contain it, in closed form on both axes.
    """
    half = window // 2
    last = F.ceil(F.col("n_species") / F.lit(shift)) - 1

    def steps(rank: Column) -> Column:
        first = F.greatest(F.lit(0).cast("bigint"), F.ceil((rank - half) / F.lit(shift)))
        final = F.least(last, F.ceil((rank + half) / F.lit(shift)) - 1)
        return F.when(first <= final, F.sequence(first, final)).otherwise(F.array().cast("array<bigint>"))

    spread = (
        ranks.join(pairs, "species_id")
        .withColumn("i", F.explode(steps(F.col("x_rank"))))
        .withColumn("j", F.explode(steps(F.col("y_rank"))))
    )
    steps_of = spread.withColumns({"x_step": F.col("i") * shift, "y_step": F.col("j") * shift})
    return grouped_deltas(steps_of, ["x_step", "y_step"], agg)
