"""Queries that fit, score and map per-species models.

Locations stand in for plots: the predictors of a location are eight numbers derived
from its order, and a species is present where an order has one of its items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from florapark.functions import features as X
from florapark.operators import experiments as E, fitting, layer, maxent, models as L, trees, weights as W
from florapark.plans.inputs import Inputs
from florapark.plans.places import MAP, NEAREST, bounds, nearest
from florapark.plans.registry import query
from florapark.plans.runs import GRID, PARAM_RUNS, PICKED, param_runs
from florapark.plans.training import BACKGROUND, packed_training_rows
from florapark.session import pin



def predictors(t: Inputs) -> DataFrame:
    """(location_id, predictors): price, priority, coordinates; standard scale by construction."""
    return t.orders.select(
        F.col("o_orderkey").alias("location_id"),
        F.array(
            (F.col("o_totalprice") - 250000) / 145000.0, (F.substring("o_orderpriority", 1, 1).cast("double") - 3) / 1.4,
            (F.col("o_orderkey") % 120 - 60) / 35.0, (F.col("o_orderkey") % 97 - 48) / 28.0).alias("predictors"))


def train_and_evaluation(t: Inputs, model: str) -> tuple[DataFrame, DataFrame]:
    x = predictors(t)
    train = packed_training_rows(t, model, x)
    split = F.when(F.col("plot_quality") < "3", "val").otherwise("test")
    rows = t.in_range_prediction.select("species_id", "location_id", "label").join(
        t.fx_location.select("location_id", split.alias("split")), "location_id").join(x, "location_id")
    return train, rows


def register_fit(name: str, model: str, **options):
    @query(name)
    def _(t: Inputs) -> DataFrame:
        train, rows = train_and_evaluation(t, model)
        _, _, metrics = L.fit_predict_many(train, rows, model, **options)
        return metrics.withColumns({m: F.round(m, 4) for m in ("auroc", "auprg")})


register_fit("l2_logistic", "logistic")
register_fit("l3_glm", "glm", C=1.0)
register_fit("l4_random_forest", "randomforest")
register_fit("l5_boosted_trees", "gradientboosting")
register_fit("l6_gam", "gam", lam=0.6)
register_fit("l5_brt", "brt")
register_fit("l7_maxent", "maxent")


@query("l1_fit_log", f"""WITH drawn AS (SELECT species_id, location_id FROM fx_presence), {BACKGROUND.format(limit='np')}
SELECT species_id, count(*) AS n_samples, CAST(sum(label) AS BIGINT) AS n_presences, 4 AS n_features, 'ok' AS status FROM pb GROUP BY 1""",
       "fx_presence fx_location fx_species_area")
def _(t):
    """What was fitted: sample sizes, and that every fit converged."""
    train, rows = train_and_evaluation(t, "logistic")
    fitted, _, _ = L.fit_predict_many(train, rows, "logistic")
    return fitted.select("species_id", "n_samples", "n_presences", "n_features", "status")


def layer_rows(t: Inputs) -> tuple[DataFrame, DataFrame]:
    """(locations with predictors, species seen there): vectors stand for locations, their labels for species."""
    x = t.fx_feature.select("location_id", F.transform("predictors", lambda v: v.cast("double")).alias("predictors"))
    return x, t.fx_feature.select("species_id", "location_id")


@query("l8_linear_multi_species")
def _(t):
    """One layer over all expanded features, every location stored once; rated on all (species, location) pairs of a block of species."""
    x, seen = layer_rows(t)
    _, model = layer.fit_layer(x, seen)
    named = model.select("species_id")
    # a stated query set: every species against every location it is or is not seen at
    rows = x.join(seen.withColumnRenamed("species_id", "own"), "location_id").withColumn("species_id", F.explode(named.agg(F.collect_set("species_id")).scalar()))
    rated = layer.score_layer(model, rows.select("species_id", "location_id", "predictors", (F.col("own") == F.col("species_id")).cast("int").alias("label")))
    metrics = L.compute_metrics(rated, ("auroc", "auprg"))
    return metrics.withColumns({m: F.round(m, 4) for m in ("auroc", "auprg")})


# ---- what must hold of a fit, worked out anew from its rows ----

COUNTS = """SELECT species_id, count(*) AS n_samples, CAST(sum(label) AS BIGINT) AS n_presences FROM pb GROUP BY 1"""
DRAWN = "WITH drawn AS (SELECT species_id, location_id FROM fx_presence), {background}"
VIEWS = "fx_presence fx_location fx_species_area"


def register_optimality(name: str, model: str, spec: L.Linear):
    @query(name, f"{DRAWN.format(background=BACKGROUND.format(limit='10000' if model in ('glm', 'gam') else 'np'))} SELECT *, 'ok' AS status, true AS optimal, true AS balanced, true AS timed FROM ({COUNTS})", VIEWS)
    def _(t: Inputs) -> DataFrame:
        train = W.presence_background_weights(packed_training_rows(t, model, predictors(t)), model)
        table = L.fit_linear(train, spec, "predictors")
        held = L.linear_residuals(train, table, spec, "predictors")
        return table.join(held, "species_id").select(
            "species_id", "n_samples", "n_presences", "status", (F.col("worst") < 1e-3).alias("optimal"),
            (F.abs("balance") < 1e-3).alias("balanced"), (F.col("seconds") > 0).alias("timed"))


register_optimality("l2_logistic_optimality", "logistic", L.Linear(l2=1.0))
register_optimality("l3_glm_optimality", "glm", L.Linear(l1=1.0, expand="squares"))
register_optimality("l6_gam_optimality", "gam", L.Linear(smooth=0.6, l2=1e-3, n_splines=10, expand="splines"))


# predictors of few values, so that every value is an edge and the best split can be told in SQL
COARSE = "cx AS (SELECT o_orderkey AS location_id, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS x1, CAST(o_orderkey % 7 AS DOUBLE) AS x2, CAST(o_orderkey % 11 AS DOUBLE) AS x3 FROM orders)"
SPLITS = """r AS (SELECT species_id, CAST(label AS DOUBLE) AS y, x1, x2, x3 FROM pb JOIN cx ON pb.location_id = cx.location_id),
v AS (SELECT species_id, y, 1 AS j, x1 AS x FROM r UNION ALL SELECT species_id, y, 2, x2 FROM r UNION ALL SELECT species_id, y, 3, x3 FROM r),
c AS (SELECT species_id, j, x, count(*) AS n, sum(y) AS k FROM v GROUP BY ALL),
s AS (SELECT species_id, j, x, sum(n) OVER w AS nl, sum(k) OVER w AS kl, sum(n) OVER (PARTITION BY species_id, j) AS n, sum(k) OVER (PARTITION BY species_id, j) AS k FROM c WINDOW w AS (PARTITION BY species_id, j ORDER BY x))"""


def coarse_rows(t: Inputs, model: str) -> DataFrame:
    x = t.orders.select(F.col("o_orderkey").alias("location_id"), F.array(
        F.substring("o_orderpriority", 1, 1).cast("double"), (F.col("o_orderkey") % 7).cast("double"), (F.col("o_orderkey") % 11).cast("double")).alias("predictors"))
    return packed_training_rows(t, model, x)


def split_sides(rows: DataFrame, root: DataFrame) -> DataFrame:
    """Rows and presences left of, and over, the root split (species_id, feature, cut) of each species."""
    left = F.get("predictors", F.col("feature").cast("int")) <= F.col("cut")
    # pinned, so that its size is known and rows are not shuffled to meet it
    return fitting.unpacked(rows).join(pin(root), "species_id").groupBy("species_id").agg(
        F.count("*").alias("n"), F.sum("label").alias("k"), F.count_if(left).alias("nl"), F.sum(F.when(left, F.col("label")).otherwise(0)).alias("kl"))


@query("l4_first_split", f"""{DRAWN.format(background=BACKGROUND.format(limit='10000'))}, {COARSE}, {SPLITS}
SELECT species_id, max(n) AS n_samples, CAST(max(k) AS BIGINT) AS n_presences, 'ok' AS status, round(max((kl * kl + (nl - kl) * (nl - kl)) / nl + ((k - kl) * (k - kl) + (n - nl - k + kl) * (n - nl - k + kl)) / (n - nl)), 5) AS purity
FROM s WHERE nl < n GROUP BY 1""", VIEWS)
def _(t):
    """Purity of the split that a tree over all rows and predictors begins with: the best there is."""
    rows = coarse_rows(t, "randomforest")
    log, grown = trees.fit_forest(rows, trees.Forest(trees=1, max_features=3, depth=1, min_leaf=1, bootstrap=False))
    sides = split_sides(rows, grown.select("species_id", F.get("nodes", 0).alias("feature"), F.get("nodes", 1).alias("cut")))
    n, k, nl, kl = (F.col(c).cast("double") for c in ("n", "k", "nl", "kl"))
    purity = (kl * kl + (nl - kl) * (nl - kl)) / nl + ((k - kl) * (k - kl) + (n - nl - k + kl) * (n - nl - k + kl)) / (n - nl)
    return sides.select("species_id", F.round(purity, 5).alias("purity")).join(log, "species_id").select("species_id", "n_samples", "n_presences", "status", "purity")


@query("l5_first_split", f"""{DRAWN.format(background=BACKGROUND.format(limit='np'))}, {COARSE}, {SPLITS},
m AS (SELECT *, (k + 0.5E0) / (n + 1) AS mu FROM s), g AS (SELECT *, kl - nl * mu AS gl, k - n * mu AS g0, mu * (1 - mu) AS u FROM m)
SELECT species_id, max(n) AS n_samples, CAST(max(k) AS BIGINT) AS n_presences, 'ok' AS status, round(max(gl * gl / (nl * u + 1) + (g0 - gl) * (g0 - gl) / ((n - nl) * u + 1)), 5) AS gain
FROM g WHERE nl < n GROUP BY 1""", VIEWS)
def _(t):
    """Gain of the split that boosting begins with: the best there is."""
    rows = coarse_rows(t, "gradientboosting")
    log, model = trees.fit_boosted(rows.withColumn("weight", F.lit(1.0)), trees.Boosted(trees=1, leaves=2, subsample=1.0))
    sides = split_sides(rows, model.select("species_id", F.get("nodes", 1).alias("feature"), F.get("nodes", 2).alias("cut")))
    n, k, nl, kl = (F.col(c).cast("double") for c in ("n", "k", "nl", "kl"))
    mu = (k + 0.5) / (n + 1)
    gl, g0, u = kl - nl * mu, k - n * mu, mu * (1 - mu)
    gain = gl * gl / (nl * u + 1) + (g0 - gl) * (g0 - gl) / ((n - nl) * u + 1)
    return sides.select("species_id", F.round(gain, 5).alias("gain")).join(log, "species_id").select("species_id", "n_samples", "n_presences", "status", "gain")


@query("l7_maxent_optimality", f"""{DRAWN.format(background=BACKGROUND.format(limit='10000'))}
SELECT *, CASE WHEN n_presences < 10 THEN 'l' WHEN n_presences < 15 THEN 'lq' WHEN n_presences < 100 THEN 'lqp' ELSE 'lqpht' END AS classes, 'ok' AS status, true AS optimal, true AS balanced, true AS timed FROM ({COUNTS})""", VIEWS)
def _(t):
    """Conditions of optimality over every feature of every species, from feature columns."""
    train = packed_training_rows(t, "maxent", predictors(t))
    log, model = maxent.fit_maxent(train)
    held = maxent.optimality(train, model).select("species_id", "balance", "worst")
    return log.join(held, "species_id").select(
        "species_id", "n_samples", "n_presences", "classes", "status", (F.col("worst") < 2e-3).alias("optimal"),
        (F.abs("balance") < 2e-3 * F.col("n_presences")).alias("balanced"), (F.col("seconds") > 0).alias("timed"))


@query("l8_layer_balance", """SELECT species_id, (SELECT count(DISTINCT location_id) FROM fx_feature) AS n_samples, count(DISTINCT location_id) AS n_presences, 6529 AS n_features, 'ok' AS status,
 CAST(count(DISTINCT location_id) AS DOUBLE) AS expected FROM fx_feature GROUP BY 1""", "fx_feature")
def _(t):
    """The intercept is free, so a species' probabilities add up to its presences."""
    x, seen = layer_rows(t)
    log, model = layer.fit_layer(x, seen)
    rows = x.withColumn("species_id", F.explode(model.agg(F.collect_set("species_id")).scalar()))
    total = layer.score_layer(model, rows).groupBy("species_id").agg(F.round(F.sum("probability"), 1).alias("expected"))
    return log.join(total, "species_id").select("species_id", "n_samples", "n_presences", "n_features", "status", "expected")


TUNED = (0.1, 1.0, 10.0)


@query("l10_tuned_fit", f"{DRAWN.format(background=BACKGROUND.format(limit='10000'))} SELECT *, 'ok' AS status, true AS as_selected, true AS from_grid, true AS timed FROM ({COUNTS})", VIEWS)
def _(t):
    """A penalty per species, chosen on the validation rows, and the fit that uses it."""
    train, rows = train_and_evaluation(t, "glm")
    log, selected, _ = L.tuned_fit(train, rows, "glm", TUNED)
    chosen = log.join(selected.select("species_id", F.col("param").alias("picked")), "species_id", "left")
    return chosen.select("species_id", "n_samples", "n_presences", "status", (F.col("param") == F.coalesce("picked", F.lit(1.0))).alias("as_selected"),
                         F.col("param").isin(*TUNED).alias("from_grid"), (F.col("seconds") > 0).alias("timed"))


# a coefficient table made from the data, so that scoring can be checked exactly
COEF = """coef AS (SELECT label AS species_id, CAST(sum(embedding[1]) AS DOUBLE) / 10 AS b0, avg(CAST(embedding[2] AS DOUBLE)) AS b1, avg(CAST(embedding[3] AS DOUBLE)) AS b2, avg(CAST(embedding[4] AS DOUBLE)) AS b3, avg(CAST(embedding[5] AS DOUBLE)) AS b4 FROM embeddings GROUP BY 1)"""
PRED_X = """px AS (SELECT o_orderkey AS location_id, (o_totalprice - 250000) / 145000.0E0 AS x1, (CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) - 3) / 1.4E0 AS x2, (o_orderkey % 120 - 60) / 35.0E0 AS x3, (o_orderkey % 97 - 48) / 28.0E0 AS x4 FROM orders)"""


def coefficient_table(t: Inputs) -> DataFrame:
    e = lambda i: F.get("embedding", i).cast("double")
    return t.embeddings.groupBy(F.col("label").alias("species_id")).agg(
        (F.sum(e(0)) / 10).alias("intercept"), F.array(*[F.avg(e(i)) for i in (1, 2, 3, 4)]).alias("coefficients")).withColumn("status", F.lit("ok"))


@query("l9_score", f"""WITH {COEF.replace('CAST(sum(embedding[1]) AS DOUBLE)', 'sum(CAST(embedding[1] AS DOUBLE))')}, {PRED_X} SELECT p.location_id, p.species_id, round(1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2 + b3 * x3 + b4 * x4))), 6) AS probability
 FROM fx_presence p JOIN px ON p.location_id = px.location_id JOIN coef ON coef.species_id = p.species_id""", "fx_presence")
def _(t):
    rows = t.fx_presence.join(predictors(t).withColumnRenamed("predictors", "features"), "location_id")
    return L.score_linear(coefficient_table(t), rows).withColumn("probability", F.round("probability", 6)).select("location_id", "species_id", "probability")


@query("l9_score_callable", f"""WITH {PRED_X} SELECT location_id, round(1 / (1 + exp(-(x1 + x2 + x3 + x4))), 6) AS probability FROM px""")
def _(t):
    def logistic_sum(x):
        import numpy as np

        return 1 / (1 + np.exp(-x.sum(axis=1)))

    scored = L.as_scorer(logistic_sum, "predictors")(predictors(t))
    return scored.withColumn("probability", F.round("probability", 6))


@query("l10_frozen_parameters", f"WITH {PARAM_RUNS}, {PICKED} SELECT s.species_id, CAST(coalesce(trunc(param), 3) AS INTEGER) AS param FROM fx_species s LEFT JOIN picked p ON s.species_id = p.species_id", "fx_seed_metric fx_species")
def _(t):
    return L.frozen_parameters(t.fx_species, E.select_hyperparameter(param_runs(t), GRID), 3, integer=True)


@query("l11_prediction_map", f"""WITH {NEAREST}, {PRED_X}, {COEF.replace('CAST(sum(embedding[1]) AS DOUBLE)', 'sum(CAST(embedding[1] AS DOUBLE))')},
st AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(x4) AS m4, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, stddev_pop(x3) AS s3, stddev_pop(x4) AS s4 FROM px),
sc AS (SELECT species_id, flat_index, l.area_code, 1 / (1 + exp(-(b0 + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2 + b3 * (x3 - m3) / s3 + b4 * (x4 - m4) / s4))) AS v
  FROM nearest n JOIN px ON n.point_id = px.location_id JOIN fx_location l ON l.location_id = n.point_id CROSS JOIN st CROSS JOIN coef),
q AS (SELECT sc.species_id, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM sc JOIN fx_species_area a ON a.species_id = sc.species_id AND a.area_code = sc.area_code GROUP BY 1)
SELECT CAST(sc.species_id AS BIGINT) AS species_id, flat_index, round(greatest(0, least(1, (v - lo) / (hi - lo))), 5) AS scaled FROM sc JOIN q ON sc.species_id = q.species_id JOIN fx_species_area a ON a.species_id = sc.species_id AND a.area_code = sc.area_code""",
       "fx_location fx_species_area")
def _(t):
    from florapark.plans.pipelines import prediction_map

    background = t.fx_location.select(F.col("location_id").alias("point_id"), "lon", "lat", "area_code").join(
        predictors(t).withColumnRenamed("location_id", "point_id"), "point_id")
    m = prediction_map(background, coefficient_table(t), t.fx_species_area, bounds(t), 0.02)
    return m.where("scaled is not null").select("species_id", "flat_index", F.round("scaled", 5).alias("scaled"))
