"""Per-species scores of predictions against 0/1 labels; a null label is ignored.

All ranking metrics come from one table: one row per (group, distinct score) with
cumulative true and false positives by falling score. Ties are merged before the
first shuffle ends, and running sums are taken inside score bands and shifted by
the totals of the higher bands, so no task ever holds a whole species.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from florapark.functions.scores import finite_or_null, score_band
from florapark.operators.ranking import group_median, quantiles
from florapark.session import pin

SPECIES = ("species_id",)
DEFAULT_METRICS = ("auroc", "auprg")


def labelled(pred: DataFrame, score: str, label: str) -> DataFrame:
    return pred.where(F.col(label).isin(0, 1) & finite_or_null(score).isNotNull())


def score_curve(
    pred: DataFrame, keys: Sequence[str] = SPECIES, score: str = "probability", label: str = "label"
) -> DataFrame:
    """One row per (keys, score): pos, neg, cumulative tp and fp, totals n_pos and n_neg."""
    keys = list(keys)
    ties = (
        labelled(pred, score, label)
        .groupBy(*keys, F.col(score).alias("score"))
        .agg(F.sum(F.col(label)).cast("bigint").alias("pos"), F.sum(1 - F.col(label)).cast("bigint").alias("neg"))
        .withColumn("band", score_band("score"))
    )
    running = (
        Window.partitionBy(*keys, "band").orderBy(F.desc("score"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    group = Window.partitionBy(*keys)
    higher = group.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = (
        ties.groupBy(*keys, "band")
        .agg(F.sum("pos").alias("band_pos"), F.sum("neg").alias("band_neg"))
        .select(
            *keys, "band",
            F.coalesce(F.sum("band_pos").over(higher), F.lit(0)).alias("tp_above"),
            F.coalesce(F.sum("band_neg").over(higher), F.lit(0)).alias("fp_above"),
            F.sum("band_pos").over(group).alias("n_pos"),
            F.sum("band_neg").over(group).alias("n_neg"),
        )
    )
    return (
        ties.withColumn("tp_local", F.sum("pos").over(running))
        .withColumn("fp_local", F.sum("neg").over(running))
        .join(bands, [*keys, "band"])
        .select(
            *keys, "score", "pos", "neg",
            (F.col("tp_above") + F.col("tp_local")).alias("tp"),
            (F.col("fp_above") + F.col("fp_local")).alias("fp"),
            "n_pos", "n_neg",
        )
    )


def _dbl(name: str) -> Column:
    return F.col(name).cast("double")


def auroc() -> Column:
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    above = _dbl("tp") - _dbl("pos")
    pairs = F.sum(_dbl("neg") * (above + _dbl("pos") / 2))
    return F.try_divide(pairs, F.max(_dbl("n_pos") * _dbl("n_neg")))


def auprc() -> Column:
    """Average precision: sum of recall steps times the precision reached."""
    steps = F.sum(F.try_divide(_dbl("pos"), _dbl("n_pos")) * F.try_divide(_dbl("tp"), _dbl("tp") + _dbl("fp")))
    return F.when(F.max("n_pos") > 0, steps)


def auprg() -> Column:
    """Area under the precision-recall-gain curve for recall gain in [0, 1].

    The curve starts where recall gain is 0, that is at tp = P*P/(P+N), with the false
    positives of that point read off the straight line between its two neighbours.
    """
    p, n = _dbl("n_pos"), _dbl("n_neg")
    tp, fp = _dbl("tp"), _dbl("fp")
    tp_prev, fp_prev = tp - _dbl("pos"), fp - _dbl("neg")
    start = p * p / (p + n)
    ratio = F.try_divide(p, n)

    def recall_gain(t: Column) -> Column:
        return 1 - ratio * F.try_divide(p - t, t)

    def precision_gain(t: Column, f: Column) -> Column:
        return 1 - ratio * F.try_divide(f, t)

    kept = F.col("tp") * (F.col("n_pos") + F.col("n_neg")) >= F.col("n_pos") * F.col("n_pos")
    crosses = tp_prev < start
    from_tp = F.when(crosses, start).otherwise(tp_prev)
    from_fp = F.when(
        crosses, fp_prev + F.try_divide(start - tp_prev, tp - tp_prev) * (fp - fp_prev)
    ).otherwise(fp_prev)
    from_rg = F.when(crosses, F.lit(0.0)).otherwise(recall_gain(from_tp))
    area = (recall_gain(tp) - from_rg) * (precision_gain(tp, fp) + precision_gain(from_tp, from_fp)) / 2
    total = F.sum(F.when(kept & (F.col("pos") > 0), area).otherwise(0.0))
    return F.when((F.max("n_pos") > 0) & (F.max("n_neg") > 0), total)


def f1(threshold: float = 0.5) -> Column:
    """F1 of ``score >= threshold``, null when it is not defined."""
    hit = F.sum(F.when(F.col("score") >= threshold, F.col("pos")).otherwise(0)).cast("double")
    false_hit = F.sum(F.when(F.col("score") >= threshold, F.col("neg")).otherwise(0)).cast("double")
    missed = F.sum(F.when(F.col("score") < threshold, F.col("pos")).otherwise(0)).cast("double")
    return F.try_divide(2 * hit, 2 * hit + false_hit + missed)


METRICS: dict[str, Callable[[], Column]] = {"auroc": auroc, "auprg": auprg, "auprc": auprc, "f1": f1}


def compute_metrics(
    pred: DataFrame,
    names: Sequence[str] = DEFAULT_METRICS,
    keys: Sequence[str] = SPECIES,
    score: str = "probability",
    label: str = "label",
) -> DataFrame:
    """One row per group with any labelled row; one column per metric, null if undefined."""
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; available: {sorted(METRICS)}")
    curve = score_curve(pred, keys, score, label)
    return curve.groupBy(*keys).agg(
        *[METRICS[n]().alias(n) for n in names],
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
    )


def to_long(metrics: DataFrame, names: Sequence[str], keys: Sequence[str] = SPECIES) -> DataFrame:
    """One row per (keys, metric, value)."""
    return metrics.select(*keys, *names).unpivot(list(keys), list(names), "metric", "value")


def macro_summary(long: DataFrame) -> DataFrame:
    """Per metric: mean over finite species times 100, median for auprg, count."""
    # one row per species and metric, used three times
    v = pin(long.withColumn("value", finite_or_null("value")).where(F.col("value").isNotNull()))
    middle = group_median(v.where(F.col("metric") == "auprg"), ["metric"], "value", "_median")
    means = v.groupBy("metric").agg((F.avg("value") * 100).alias("macro"), F.count("*").alias("n"))
    return means.join(middle, "metric", "left").select("metric", "macro", (F.col("_median") * 100).alias("median"), "n")


def average(per_species: DataFrame, value: str, weight: str = "n_pos", mode: str = "macro") -> DataFrame:
    """One number over the species where ``value`` is defined; ``none`` keeps them all."""
    defined = per_species.withColumn(value, finite_or_null(value)).where(F.col(value).isNotNull())
    if mode == "none":
        return defined
    if mode == "median":
        defined = pin(defined.select(value))
        return quantiles(defined, value, [0.5], [value]).select(F.lit(mode).alias("mode"), value)
    reducers = {
        "macro": F.avg(value),
        "weighted": F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight).cast("double")),
    }
    if mode not in reducers:
        raise ValueError(f"mode must be one of {[*reducers, 'median', 'none']}")
    return defined.agg(F.lit(mode).alias("mode"), reducers[mode].alias(value))


def metric_delta(model: DataFrame, reference: DataFrame, keys: Sequence[str] = ("species_id", "metric")) -> DataFrame:
    """Model value minus reference value per key; null where either is undefined."""
    ref = reference.select(*keys, finite_or_null("value").alias("reference_value"))
    return (
        model.withColumn("value", finite_or_null("value"))
        .join(ref, list(keys), "left")
        .withColumn("delta", F.col("value") - F.col("reference_value"))
    )


THRESHOLD_STEPS = 20  # cut at k/20 for k = 1 .. 19


def confusion(
    pred: DataFrame, keys: Sequence[str] = SPECIES, score: str = "probability", label: str = "label",
    steps: int = THRESHOLD_STEPS,
) -> DataFrame:
    """TP, FP, TN, FN per group at every threshold k/steps, ``score >= threshold``.

    Each row falls into one step; counts per step are then added from the top, so
    rows are never copied per threshold.
    """
    keys = list(keys)
    s = F.col(score).cast("double")
    guess = F.greatest(F.lit(0), F.least(F.lit(steps), F.floor(s * steps).cast("int")))
    # settle rounding at the edges with the same comparison the definition uses
    passed = (
        F.when((guess < steps) & (s >= (guess + 1) / F.lit(float(steps))), guess + 1)
        .when(s < guess / F.lit(float(steps)), guess - 1)
        .otherwise(guess)
    )
    per_step = (
        labelled(pred, score, label)
        .groupBy(*keys, F.greatest(F.lit(0), passed).alias("passed"))
        .agg(F.sum(label).cast("bigint").alias("pos"), F.sum(1 - F.col(label)).cast("bigint").alias("neg"))
    )
    # at most one entry per step and group
    per_group = per_step.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.collect_list(F.struct("passed", "pos", "neg")).alias("parts"))

    def at_least(k: Column, what: str) -> Column:
        return F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, r: a + F.when(r["passed"] >= k, r[what]).otherwise(0))

    rows = per_group.select(*keys, "n_pos", "n_neg", F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(steps - 1)),
        lambda k: F.struct(k.alias("k"), at_least(k, "pos").alias("tp"), at_least(k, "neg").alias("fp")))).alias("r"))
    return rows.select(
        *keys, (F.col("r.k") / F.lit(float(steps))).alias("threshold"), F.col("r.tp").alias("tp"), F.col("r.fp").alias("fp"),
        (F.col("n_neg") - F.col("r.fp")).alias("tn"), (F.col("n_pos") - F.col("r.tp")).alias("fn"))


def point_class(score: str, label: str, threshold: float) -> Column:
    """TP, FP, TN or FN for one point; null if the label is ignored."""
    hit = F.col(score) >= threshold
    return (
        F.when((F.col(label) == 1) & hit, "TP").when((F.col(label) == 1) & ~hit, "FN")
        .when((F.col(label) == 0) & hit, "FP").when((F.col(label) == 0) & ~hit, "TN")
    )


def binarise(score: str, threshold: float) -> Column:
    value = finite_or_null(score)
    return F.when(value.isNotNull(), (value >= threshold).cast("int"))


def best_so_far(epochs: DataFrame, order: str = "epoch") -> DataFrame:
    """Per metric and epoch the reduced value (auprg by median, others by mean) and its running maximum.

    The window runs over one row per epoch.
    """
    v = epochs.withColumn("value", finite_or_null("value"))
    keys = ["metric", order]
    middle = group_median(v.where(F.col("metric") == "auprg"), keys, "value", "_median")
    reduced = v.groupBy(*keys).agg(F.avg("value").alias("_mean")).join(middle, keys, "left").select(
        *keys, F.when(F.col("metric") == "auprg", F.col("_median")).otherwise(F.col("_mean")).alias("value"))
    w = Window.partitionBy("metric").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return reduced.withColumn("best", F.max("value").over(w))
