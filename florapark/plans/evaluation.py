"""Queries on scores, strata and experiment runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from florapark.operators import metrics as M, properties as R, stratify as K
from florapark.plans.inputs import Inputs
from florapark.plans.registry import query


def r6(*names: str):
    return {n: F.round(F.col(n), 6) for n in names}


PRED_VIEWS = "fx_location fx_species_area fx_prediction masked"

# ranking scores by their textbook definitions: average ranks, and running totals with lag
SCORES = """
labelled AS (SELECT * FROM masked WHERE label IS NOT NULL),
totals AS (SELECT species_id, sum(label) AS p, sum(1 - label) AS n FROM labelled GROUP BY species_id),
avg_rank AS (SELECT species_id, label,
    rank() OVER (PARTITION BY species_id ORDER BY {score})
      + (count(*) OVER (PARTITION BY species_id, {score}) - 1) / 2.0 AS rk FROM labelled),
auroc AS (SELECT t.species_id, CASE WHEN p > 0 AND n > 0
    THEN (sum(CASE WHEN label = 1 THEN rk ELSE 0 END) - p * (p + 1) / 2.0) / (p * n) END AS auroc
    FROM avg_rank a JOIN totals t ON a.species_id = t.species_id GROUP BY t.species_id, p, n),
ties AS (SELECT species_id, {score} AS score, sum(label) AS pos, sum(1 - label) AS neg FROM labelled GROUP BY 1, 2),
curve AS (SELECT ties.species_id, score, p, n,
    CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp
    FROM ties JOIN totals t ON ties.species_id = t.species_id
    WINDOW w AS (PARTITION BY ties.species_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
steps AS (SELECT *, coalesce(lag(tp) OVER w, 0) AS tp0, coalesce(lag(fp) OVER w, 0) AS fp0 FROM curve
    WINDOW w AS (PARTITION BY species_id ORDER BY score DESC)),
auprc AS (SELECT species_id, CASE WHEN p > 0 THEN sum((tp - tp0) / p * tp / (tp + fp)) END AS auprc
    FROM steps GROUP BY species_id, p),
gain AS (SELECT *, p * p / CAST(p + n AS DOUBLE) AS c, p / CAST(n AS DOUBLE) AS pn FROM steps WHERE p > 0 AND n > 0),
gain2 AS (SELECT *, CASE WHEN tp0 < c THEN c ELSE tp0 END AS ta,
    CASE WHEN tp0 < c THEN fp0 + (c - tp0) / (tp - tp0) * (fp - fp0) ELSE fp0 END AS fa
    FROM gain WHERE tp * (p + n) >= p * p AND tp > tp0),
auprg AS (SELECT species_id, sum(((1 - pn * (p - tp) / tp) - (1 - pn * (p - ta) / ta))
    * ((1 - pn * fp / tp) + (1 - pn * fa / ta)) / 2) AS auprg FROM gain2 GROUP BY species_id),
f1 AS (SELECT species_id, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM (
    SELECT species_id, count(*) FILTER (WHERE label = 1 AND {score} >= 0.5) AS tp,
           count(*) FILTER (WHERE label = 0 AND {score} >= 0.5) AS fp,
           count(*) FILTER (WHERE label = 1 AND {score} < 0.5) AS fn FROM labelled GROUP BY species_id))"""


def scores(column: str = "probability") -> str:
    return "WITH " + SCORES.format(score=column).strip()


def run_metrics(t: Inputs, score: str = "probability", names=("auroc", "auprg")) -> DataFrame:
    return M.compute_metrics(t.in_range_prediction, names, score=score)


def long_metrics(t: Inputs, score: str = "probability", names=("auroc", "auprg")) -> DataFrame:
    return M.to_long(run_metrics(t, score, names), names)


def properties(t: Inputs) -> DataFrame:
    return R.sampling_properties(t.fx_species, t.fx_presence, t.fx_location, t.fx_species_area)


PROP_VIEWS = "fx_species fx_species_area fx_location fx_presence"

PROPS = """
in_range AS (SELECT a.species_id, count(*) AS n FROM fx_species_area a JOIN fx_location l ON a.area_code = l.area_code GROUP BY 1),
seen_in_range AS (SELECT a.species_id, count(*) AS n FROM fx_species_area a JOIN fx_location l ON a.area_code = l.area_code
    WHERE l.location_id IN (SELECT location_id FROM fx_presence) GROUP BY 1),
obs AS (SELECT species_id, count(*) AS n FROM fx_presence GROUP BY 1),
props AS (SELECT s.species_id, coalesce(i.n, 0) AS n_cells_in_range, coalesce(v.n, 0) AS n_cells_visited_in_range,
    coalesce(o.n, 0) AS n_species_obs, v.n * 100.0E0 / nullif(i.n, 0) AS sampling_effort,
    coalesce(o.n, 0) * 100.0E0 / nullif(v.n, 0) AS relative_prevalence
    FROM fx_species s LEFT JOIN in_range i ON s.species_id = i.species_id
    LEFT JOIN seen_in_range v ON s.species_id = v.species_id LEFT JOIN obs o ON s.species_id = o.species_id)"""

STRATA = """
ranks AS (SELECT species_id, row_number() OVER (ORDER BY sampling_effort, species_id) AS x,
    row_number() OVER (ORDER BY relative_prevalence, species_id) AS y, count(*) OVER () AS n
    FROM props WHERE sampling_effort IS NOT NULL AND relative_prevalence IS NOT NULL),
member AS (
    SELECT species_id, 'bottom_left' AS region FROM ranks WHERE x <= n // 2 AND y <= n // 2
    UNION ALL SELECT species_id, 'top_left' FROM ranks WHERE x <= n // 2 AND y > n // 2
    UNION ALL SELECT species_id, 'bottom_right' FROM ranks WHERE x > n // 2 AND y <= n // 2
    UNION ALL SELECT species_id, 'top_right' FROM ranks WHERE x > n // 2 AND y > n // 2
    UNION ALL SELECT species_id, 'L3_left_lower' FROM ranks WHERE x <= n // 10 AND y <= n // 2 AND NOT (y <= n // 10 AND x >= y)
    UNION ALL SELECT species_id, 'L4_left_upper' FROM ranks WHERE x <= n // 10 AND y > n // 2
    UNION ALL SELECT species_id, 'L1_bottom_left' FROM ranks WHERE y <= n // 10 AND x <= n // 2 AND NOT (x <= n // 10 AND x < y)
    UNION ALL SELECT species_id, 'L2_bottom_right' FROM ranks WHERE y <= n // 10 AND x > n // 2),
names AS (SELECT * FROM (VALUES (0, 'bottom_left', 'sparse-infrequent'), (1, 'top_left', 'sparse-frequent'),
    (2, 'bottom_right', 'dense-infrequent'), (3, 'top_right', 'dense-frequent'),
    (4, 'L3_left_lower', 'sparse(p10) x infrequent-half'), (5, 'L4_left_upper', 'sparse(p10) x frequent-half'),
    (6, 'L1_bottom_left', 'infrequent(p10) x sparse-half'), (7, 'L2_bottom_right', 'infrequent(p10) x dense-half')) v("position", region, stratum))"""


def flagship(t: Inputs) -> DataFrame:
    """Mean AUROC and AUPRG per sampling stratum."""
    report = K.stratified_report(long_metrics(t), properties(t), names=("auroc", "auprg"))
    return report.withColumns(r6("score"))


query("k3_stratified_report", f"""{scores()}, {PROPS}, {STRATA},
long AS (SELECT t.species_id, 'auroc' AS metric, auroc AS value FROM totals t LEFT JOIN auroc a ON t.species_id = a.species_id
  UNION ALL SELECT t.species_id, 'auprg', auprg FROM totals t LEFT JOIN auprg a ON t.species_id = a.species_id)
SELECT "position", names.region, stratum, k.metric, round(avg(value) * 100, 6) AS score, count(value) AS n
FROM names CROSS JOIN (SELECT DISTINCT metric FROM long) k LEFT JOIN member ON member.region = names.region
LEFT JOIN long ON long.species_id = member.species_id AND long.metric = k.metric
GROUP BY ALL""", PRED_VIEWS + " fx_species fx_presence")(flagship)


@query("m1_auroc", f"{scores()} SELECT species_id, round(auroc, 6) AS auroc FROM auroc", PRED_VIEWS)
def _(t):
    return run_metrics(t, names=("auroc",)).select("species_id", F.round("auroc", 6).alias("auroc"))


@query("m2_auprg", f"{scores('probability_fine')} SELECT t.species_id, round(auprg, 6) AS auprg FROM totals t LEFT JOIN auprg a ON t.species_id = a.species_id", PRED_VIEWS)
def _(t):
    return run_metrics(t, "probability_fine", ("auprg",)).select("species_id", F.round("auprg", 6).alias("auprg"))


@query("m3_auprc", f"{scores('probability_fine')} SELECT species_id, round(auprc, 6) AS auprc FROM auprc", PRED_VIEWS)
def _(t):
    return run_metrics(t, "probability_fine", ("auprc",)).select("species_id", F.round("auprc", 6).alias("auprc"))


@query("m4_f1", f"{scores()} SELECT species_id, round(f1, 6) AS f1 FROM f1", PRED_VIEWS)
def _(t):
    return run_metrics(t, names=("f1",)).select("species_id", F.round("f1", 6).alias("f1"))


@query("m5_compute_metrics", f"""{scores('probability_fine')}
SELECT t.species_id, round(auroc, 6) AS auroc, round(auprg, 6) AS auprg, round(auprc, 6) AS auprc, round(f1, 6) AS f1,
       CAST(p AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg
FROM totals t LEFT JOIN auroc USING (species_id) LEFT JOIN auprg USING (species_id)
LEFT JOIN auprc USING (species_id) LEFT JOIN f1 USING (species_id)""", PRED_VIEWS)
def _(t):
    names = ("auroc", "auprg", "auprc", "f1")
    return run_metrics(t, "probability_fine", names).withColumns(r6(*names))


LONG = """
long AS (SELECT t.species_id, 'auroc' AS metric, auroc AS value FROM totals t LEFT JOIN auroc a ON t.species_id = a.species_id
  UNION ALL SELECT t.species_id, 'auprg', auprg FROM totals t LEFT JOIN auprg a ON t.species_id = a.species_id)"""


@query("m6_macro_summary", f"""{scores()}, {LONG}
SELECT metric, round(avg(value) * 100, 6) AS macro,
       CASE WHEN metric = 'auprg' THEN round(median(value) * 100, 6) END AS median, count(value) AS n
FROM long WHERE value IS NOT NULL GROUP BY metric""", PRED_VIEWS)
def _(t):
    return M.macro_summary(long_metrics(t)).withColumns(r6("macro", "median"))


@query("m7_average", f"""{scores()}, d AS (SELECT a.species_id, auroc, p FROM auroc a JOIN totals t ON a.species_id = t.species_id WHERE auroc IS NOT NULL)
SELECT 'macro' AS mode, round(avg(auroc), 6) AS auroc FROM d UNION ALL SELECT 'median', round(median(auroc), 6) FROM d
UNION ALL SELECT 'weighted', round(sum(auroc * p) / sum(p), 6) FROM d""", PRED_VIEWS)
def _(t):
    m = run_metrics(t, names=("auroc",))
    rows = [M.average(m, "auroc", mode=k) for k in ("macro", "median", "weighted")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumns(r6("auroc"))


def metric_pair(score_a: str, score_b: str) -> str:
    """AUROC of two score columns as tables a(species_id, value) and b."""
    one = SCORES.split("ties AS")[0].rstrip().rstrip(",")
    a = one.replace("{score}", score_a).replace("labelled", "lab_a").replace("totals", "tot_a").replace("avg_rank", "rk_a").replace("auroc AS (", "ma AS (")
    b = one.replace("{score}", score_b).replace("labelled", "lab_b").replace("totals", "tot_b").replace("avg_rank", "rk_b").replace("auroc AS (", "mb AS (")
    return "WITH " + a.strip() + "," + b


PAIRS = """pairs AS (SELECT ma.species_id, ma.auroc * 100 AS v1, mb.auroc * 100 AS v2 FROM ma JOIN mb ON ma.species_id = mb.species_id
    WHERE ma.auroc IS NOT NULL AND mb.auroc IS NOT NULL)"""


@query("m8_metric_delta", f"""{metric_pair('probability_fine', 'probability_ref')}
SELECT ma.species_id, 'auroc' AS metric, round(ma.auroc, 6) AS value, round(mb.auroc, 6) AS reference_value, round(ma.auroc - mb.auroc, 6) AS delta
FROM ma LEFT JOIN mb ON ma.species_id = mb.species_id""", PRED_VIEWS)
def _(t):
    d = M.metric_delta(long_metrics(t, "probability_fine", ("auroc",)), long_metrics(t, "probability_ref", ("auroc",)))
    return d.withColumns(r6("value", "reference_value", "delta"))


@query("m9_confusion", """WITH k AS (SELECT unnest(range(1, 20)) AS k)
SELECT species_id, k / 20.0E0 AS threshold,
 CAST(count(*) FILTER (WHERE label = 1 AND probability >= k / 20.0E0) AS BIGINT) AS tp,
 CAST(count(*) FILTER (WHERE label = 0 AND probability >= k / 20.0E0) AS BIGINT) AS fp,
 CAST(count(*) FILTER (WHERE label = 0 AND probability < k / 20.0E0) AS BIGINT) AS tn,
 CAST(count(*) FILTER (WHERE label = 1 AND probability < k / 20.0E0) AS BIGINT) AS fn
FROM masked CROSS JOIN k WHERE label IS NOT NULL GROUP BY species_id, k""", PRED_VIEWS)
def _(t):
    return M.confusion(t.in_range_prediction)


@query("m9_point_class", """SELECT location_id, species_id, CASE WHEN label = 1 AND probability_fine >= 0.5 THEN 'TP' WHEN label = 1 THEN 'FN'
 WHEN label = 0 AND probability_fine >= 0.5 THEN 'FP' WHEN label = 0 THEN 'TN' END AS class FROM masked""", PRED_VIEWS)
def _(t):
    return t.in_range_prediction.select("location_id", "species_id", M.point_class("probability_fine", "label", 0.5).alias("class"))


@query("m10_binarise", "SELECT location_id, species_id, CASE WHEN probability_fine >= 0.5 THEN 1 ELSE 0 END AS present FROM fx_prediction", "fx_prediction")
def _(t):
    return t.fx_prediction.select("location_id", "species_id", M.binarise("probability_fine", 0.5).alias("present"))


# validation and test rows by plot quality, the two parts of an evaluation table
SPLIT_PRED = """sp AS (SELECT m.*, CASE WHEN l.plot_quality < '3' THEN 'val' ELSE 'test' END AS split
  FROM masked m JOIN fx_location l ON m.location_id = l.location_id)"""


def split_prediction(t: Inputs) -> DataFrame:
    part = F.when(F.col("plot_quality") < "3", "val").otherwise("test")
    return t.in_range_prediction.join(t.fx_location.select("location_id", part.alias("split")), "location_id")


@query("m11_per_split_metrics", f"""WITH {SPLIT_PRED}, lab AS (SELECT * FROM sp WHERE label IS NOT NULL),
rk AS (SELECT split, species_id, label, rank() OVER (PARTITION BY split, species_id ORDER BY probability)
  + (count(*) OVER (PARTITION BY split, species_id, probability) - 1) / 2.0 AS rk FROM lab),
s AS (SELECT split, species_id, sum(label) AS p, sum(1 - label) AS n, sum(label * rk) AS r FROM rk GROUP BY ALL)
SELECT split, species_id, CASE WHEN p > 0 AND n > 0 THEN round((r - p * (p + 1) / 2.0) / (p * n), 6) END AS auroc,
 CAST(p AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg FROM s""", PRED_VIEWS)
def _(t):
    return M.compute_metrics(split_prediction(t), ("auroc",), keys=("split", "species_id")).withColumns(r6("auroc"))


@query("m12_best_so_far", """WITH e AS (SELECT seed AS epoch, 'auroc' AS metric, value FROM fx_seed_metric UNION ALL SELECT seed, 'auprg', value * value FROM fx_seed_metric),
r AS (SELECT metric, epoch, CASE WHEN metric = 'auprg' THEN median(value) ELSE avg(value) END AS value FROM e GROUP BY metric, epoch)
SELECT metric, epoch, round(value, 6) AS value, round(max(value) OVER (PARTITION BY metric ORDER BY epoch ROWS UNBOUNDED PRECEDING), 6) AS best FROM r""", "fx_seed_metric")
def _(t):
    e = t.fx_seed_metric.withColumnRenamed("seed", "epoch")
    tall = e.select("epoch", F.lit("auroc").alias("metric"), "value").unionByName(
        e.select("epoch", F.lit("auprg").alias("metric"), (F.col("value") * F.col("value")).alias("value")))
    return M.best_so_far(tall).withColumns(r6("value", "best"))


# ---- strata ----


def ranks(t: Inputs) -> DataFrame:
    return K.ordinal_ranks(properties(t))


def auroc_pairs(t: Inputs) -> DataFrame:
    a, b = (long_metrics(t, s, ("auroc",)) for s in ("probability_fine", "probability_ref"))
    return K.paired(a, b)


ALL_VIEWS = PRED_VIEWS + " fx_species fx_presence"


@query("k1_ordinal_ranks", f"WITH {PROPS}, {STRATA} SELECT species_id, x AS x_rank, y AS y_rank, n AS n_species FROM ranks", PROP_VIEWS)
def _(t):
    return ranks(t)


@query("k2_regions", f"WITH {PROPS}, {STRATA} SELECT species_id, region FROM member", PROP_VIEWS)
def _(t):
    return K.regions(ranks(t))


@query("k3_paired_report", f"""{metric_pair('probability_fine', 'probability_ref')}, {PROPS}, {STRATA}
SELECT "position", names.region, stratum, 'auroc' AS metric, round(avg(ma.auroc - mb.auroc) * 100, 6) AS score, count(ma.auroc - mb.auroc) AS n
FROM names LEFT JOIN member ON member.region = names.region LEFT JOIN ma ON ma.species_id = member.species_id
LEFT JOIN mb ON mb.species_id = ma.species_id GROUP BY ALL""", ALL_VIEWS)
def _(t):
    a, b = (long_metrics(t, s, ("auroc",)) for s in ("probability_fine", "probability_ref"))
    return K.stratified_report(a, properties(t), reference=b, names=("auroc",)).withColumns(r6("score"))


@query("k3_evaluation_report", f"""{metric_pair('probability_fine', 'probability_ref')}, {PROPS}, {STRATA}
SELECT "position", names.region, stratum, 'auroc' AS metric, round(avg(ma.auroc - mb.auroc) * 100, 6) AS score, count(ma.auroc - mb.auroc) AS n
FROM names LEFT JOIN member ON member.region = names.region LEFT JOIN ma ON ma.species_id = member.species_id
LEFT JOIN mb ON mb.species_id = ma.species_id GROUP BY ALL""", ALL_VIEWS)
def _(t):
    """The whole evaluation in one call, checks included."""
    from florapark.plans.pipelines import evaluate_predictions

    model, other = (t.fx_prediction.select("location_id", "species_id", F.col(c).alias("probability"), "label")
                    for c in ("probability_fine", "probability_ref"))
    done = evaluate_predictions(model, t.fx_location, t.fx_species, t.fx_species_area, t.fx_presence,
                                reference=other, names=("auroc",))
    return done.report.withColumns(r6("score"))


def region_delta_sql(expr: str) -> str:
    return f"""{metric_pair('probability_fine', 'probability_ref')}, {PROPS}, {STRATA}, {PAIRS}
SELECT names.region, count(v1) AS n, round(coalesce({expr}, 0), 6) AS delta
FROM names LEFT JOIN member ON member.region = names.region LEFT JOIN pairs ON pairs.species_id = member.species_id GROUP BY names.region"""


@query("k4_region_deltas", region_delta_sql("median(v2) - median(v1)"), ALL_VIEWS)
def _(t):
    return K.region_deltas(K.regions(ranks(t)), auroc_pairs(t), "median").withColumns(r6("delta"))


@query("k4_region_deltas_mean", region_delta_sql("avg(v2) - avg(v1)"), ALL_VIEWS)
def _(t):
    return K.region_deltas(K.regions(ranks(t)), auroc_pairs(t), "mean").withColumns(r6("delta"))


@query("k5_paired_median", region_delta_sql("median(v2 - v1)"), ALL_VIEWS)
def _(t):
    return K.region_deltas(K.regions(ranks(t)), auroc_pairs(t), "paired_median").withColumns(r6("delta"))


@query("k6_seed_stacked_delta", f"""WITH {PROPS}, {STRATA},
pairs AS (SELECT seed, species_id, value * 100 AS v1, value * value * 100 AS v2 FROM fx_seed_metric WHERE value IS NOT NULL),
full_sp AS (SELECT species_id FROM pairs GROUP BY species_id HAVING count(DISTINCT seed) = 5),
per_seed AS (SELECT region, seed, count(*) AS n, median(v2) - median(v1) AS delta FROM member JOIN pairs ON member.species_id = pairs.species_id
  WHERE pairs.species_id IN (SELECT species_id FROM full_sp) GROUP BY region, seed),
got AS (SELECT region, max(n) AS n, avg(delta) AS delta FROM per_seed GROUP BY region)
SELECT names.region, coalesce(n, 0) AS n, round(coalesce(delta, 0), 6) AS delta FROM names LEFT JOIN got ON got.region = names.region""",
       PROP_VIEWS + " fx_seed_metric")
def _(t):
    a = t.fx_seed_metric
    b = a.withColumn("value", F.col("value") * F.col("value"))
    pairs = K.paired(a, b, ("seed", "species_id"))
    return K.seed_stacked_deltas(K.regions(ranks(t)), pairs, 5, "median").withColumns(r6("delta"))


@query("k7_moving_window_grid", f"""{metric_pair('probability_fine', 'probability_ref')}, {PROPS}, {STRATA}, {PAIRS},
total AS (SELECT max(n) AS n FROM ranks), steps AS (SELECT unnest(range(0, CAST((SELECT n FROM total) AS BIGINT), 5)) AS s)
SELECT sx.s AS x_step, sy.s AS y_step, count(*) AS n, round(avg(v2) - avg(v1), 6) AS delta
FROM ranks JOIN pairs ON ranks.species_id = pairs.species_id
JOIN steps sx ON x > greatest(0, sx.s - 10) AND x <= least(n, sx.s + 10)
JOIN steps sy ON y > greatest(0, sy.s - 10) AND y <= least(n, sy.s + 10) GROUP BY 1, 2""", ALL_VIEWS)
def _(t):
    return K.moving_window_grid(ranks(t), auroc_pairs(t), window=20, shift=5).withColumns(r6("delta"))
