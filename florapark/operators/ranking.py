"""Global order, per-group top-n and exact quantiles without a single-task sort.

A window without ``partitionBy``, or one over a very large group, runs in one task.
The functions here give the same answers from many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from florapark.session import pin

# monotonically_increasing_id keeps the partition number above this bit
_PARTITION_BIT = 33


def global_index(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Number all rows 0, 1, 2, ... in the given order.

    Rows are range-partitioned, sorted inside each partition and pinned; the only
    global step is a running sum over one row per partition. ``order`` must be
    unique per row for the numbering to be repeatable.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    local = pin(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mono", F.monotonically_increasing_id())
    )
    part = F.shiftright("_mono", _PARTITION_BIT)
    sizes = local.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition, so this window and this broadcast are bounded by the partition count
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    offset = F.col("_mono") - F.shiftleft(part, _PARTITION_BIT)
    return (
        local.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_start") + offset).cast("bigint"))
        .drop("_part", "_start", "_mono")
    )


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each group; an aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)


def top_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int | Column, salts: int | None = None
) -> DataFrame:
    """At most ``n`` rows per group in the given order, exactly.

    Stage one ranks inside ``salts`` slices of each group (by default as many as there are
    shuffle partitions, so that slices follow the cluster), so that a group holding
    a third of the table is sorted by many tasks; stage two ranks the survivors.
    ``n`` may be a column that is constant inside a group.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    limit = F.lit(n) if isinstance(n, int) else n
    slices = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.pmod(F.hash(*order), F.lit(salts)))
    return (
        salted.withColumn("_rank", F.row_number().over(slices))
        .where(F.col("_rank") <= limit)
        .withColumn("_rank", F.row_number().over(whole))
        .where(F.col("_rank") <= limit)
        .drop("_salt", "_rank")
    )


ROWS_PER_TASK = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` (about ``rows`` rows) hash-partitioned by ``keys``, a partition for every ``ROWS_PER_TASK`` rows.

    Small partitions of a shuffle are put together until there is one per core, and the tasks of a scan grow
    with the file, so that sorts and aggregates of a task would grow with the table; these do not. Tables with so few rows stay as they are.
    """
    parts = -(-rows // ROWS_PER_TASK)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df


ROWS_PER_SLICE = 65_536


def digest_slice(hex_digest: Column, group_rows: Column) -> Column:
    """Slice number in digest order; a group gets as many slices as its size calls for, most get one."""
    share = F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("double") / float(16**8)
    return F.floor(share * F.ceil(group_rows / ROWS_PER_SLICE))


def value_band(value: Column | str) -> Column:
    """Coarse band of any real number, never decreasing with it, even on a signed log scale."""
    v = F.col(value) if isinstance(value, str) else value
    size = F.floor(F.log1p(F.abs(v) * 1000) * 16)
    return F.when(v < 0, -size).otherwise(size)


_NO_SLICE = -(1 << 62)


def running_sum_in_group(
    df: DataFrame, keys: Sequence[str], slice_col: Column, order: Sequence[Column | str], value: Column, name: str,
    nullable: Sequence[str] = (),
) -> DataFrame:
    """Sum of ``value`` over a row and the rows before it in its group, computed slice by slice.

    ``slice_col`` must not decrease along ``order``. The sum is the running sum in the
    slice plus the totals of the earlier slices of the group, so a large group is
    worked on by as many tasks as it has slices. Keys that may be null are named in
    ``nullable``.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    sliced = df.withColumn("_slice", F.coalesce(slice_col.cast("bigint"), F.lit(_NO_SLICE))).withColumn("_value", value)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum("_value").alias("_n"))
        .select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.col("_slice").alias("_k_slice"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        )
    )
    same = F.col("_slice") == F.col("_k_slice")
    for k in keys:
        a, b = F.col(k), F.col(f"_k_{k}")
        same = same & (a.eqNullSafe(b) if k in nullable else a == b)
    local = (
        Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        sliced.withColumn("_local", F.sum("_value").over(local))
        .join(starts, same)
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_slice", "_k_slice", "_local", "_start", "_value", *[f"_k_{k}" for k in keys])
    )


def rank_in_group(
    df: DataFrame, keys: Sequence[str], slice_col: Column, order: Sequence[Column | str], name: str,
    nullable: Sequence[str] = (),
) -> DataFrame:
    """1-based position of each row in its group."""
    return running_sum_in_group(df, keys, slice_col, order, F.lit(1).cast("bigint"), name, nullable)


def weighted_quantiles(
    ties: DataFrame, keys: Sequence[str], value: str, count: str, slice_col: Column, probs: Sequence[float],
    names: Sequence[str],
) -> DataFrame:
    """Exact linearly interpolated quantiles per group of values that each occur ``count`` times.

    See ``running_sum_in_group`` for ``slice_col``.
    """
    used = ties.where((F.col(count) > 0) & F.col(value).isNotNull()).select(*keys, value, F.col(count).alias("_c"))
    upto = running_sum_in_group(used, keys, slice_col, [value], F.col("_c"), "_upto")
    total = used.groupBy(*keys).agg(F.sum("_c").alias("_total"))
    ranked = upto.join(total, list(keys))
    picks = []
    for p, name in zip(probs, names):
        at = F.lit(p) * (F.col("_total") - 1)
        first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1  # 0-based places this value fills
        low = F.max(F.when(F.floor(at).between(first, last), F.col(value)))
        high = F.max(F.when((F.floor(at) + 1).between(first, last), F.col(value)))
        share = F.max(at - F.floor(at))
        picks.append((low + share * (F.coalesce(high, low) - low)).alias(name))
    return ranked.groupBy(*keys).agg(*picks)


def group_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, median) over the non-null values, without holding a group in one place."""
    ties = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return weighted_quantiles(ties, keys, value, "_n", value_band(value), [0.5], [name])


def quantiles(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact linearly interpolated quantiles of one column as a single row.

    Rows are numbered in order; only those around each cut position reach the final
    aggregate.
    """
    ordered = global_index(df.where(F.col(value).isNotNull()).select(value, F.monotonically_increasing_id().alias("_tie")),
                           [value, "_tie"], "_i")
    total = ordered.agg(F.count("*").alias("_n")).scalar()
    ranked = ordered.withColumn("_n", total)
    cuts = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    near = F.lit(False)
    for c in cuts:
        near = near | F.col("_i").between(F.floor(c), F.floor(c) + 1)
    around = ranked.where(near)
    picks = []
    for c, name in zip(cuts, names):
        low = F.max(F.when(F.col("_i") == F.floor(c), F.col(value)))
        high = F.max(F.when(F.col("_i") == F.floor(c) + 1, F.col(value)))
        share = F.max(c - F.floor(c))
        picks.append((low + share * (F.coalesce(high, low) - low)).alias(name))
    return around.agg(*picks)
