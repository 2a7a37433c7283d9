"""Queries on experiment runs, job outputs, and table sources and sinks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, functions as F

from florapark.operators import experiments as E
from florapark.plans.evaluation import ALL_VIEWS, LONG, PRED_VIEWS, long_metrics, r6, scores
from florapark.plans.inputs import Inputs
from florapark.plans.registry import query
from florapark.sources import predictions as P, tables as S


def out_dir(t: Inputs) -> str:
    """A new folder for tables written by a query: next to the shared checkpoint folder, else local."""
    shared = t.spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid

        return f"{shared.rstrip('/')}/florapark-{uuid.uuid4().hex}"
    if not t.spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@query("e1_seed_summary", """SELECT species_id, round(avg(value), 4) AS mean, CASE WHEN count(value) >= 2 THEN round(stddev_pop(value), 6) END AS std,
 count(value) AS n_seeds FROM fx_seed_metric WHERE value IS NOT NULL GROUP BY species_id""", "fx_seed_metric")
def _(t):
    return E.seed_summary(t.fx_seed_metric).withColumns({"mean": F.round("mean", 4), **r6("std")})


@query("e2_macro_over_seeds", """WITH good AS (SELECT * FROM fx_seed_metric WHERE value IS NOT NULL),
c AS (SELECT species_id FROM good GROUP BY 1 HAVING count(DISTINCT seed) = 5),
s AS (SELECT 'union' AS species_set, * FROM good UNION ALL SELECT 'common', * FROM good WHERE species_id IN (SELECT species_id FROM c)),
p AS (SELECT species_set, seed, avg(value) AS m, median(value) AS md FROM s GROUP BY 1, 2)
SELECT species_set, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS mean_std, round(avg(md), 6) AS median,
 round(stddev_pop(md), 6) AS median_std, count(*) AS n_seeds FROM p GROUP BY 1""", "fx_seed_metric")
def _(t):
    return E.macro_over_seeds(t.fx_seed_metric, 5).withColumns(r6("mean", "mean_std", "median", "median_std"))


@query("e3_seed_coverage", """SELECT n_seeds, count(*) AS n_species FROM (SELECT s.species_id, count(DISTINCT CASE WHEN value IS NOT NULL THEN seed END) AS n_seeds
 FROM fx_species s LEFT JOIN fx_seed_metric m ON s.species_id = m.species_id GROUP BY 1) GROUP BY 1""", "fx_species fx_seed_metric")
def _(t):
    return E.seed_coverage(t.fx_seed_metric, t.fx_species)


# two metrics that are defined for different seeds
TWO_METRICS = "tm AS (SELECT species_id, seed, 'plain' AS metric, value FROM fx_seed_metric UNION ALL SELECT species_id, seed, 'even', CASE WHEN (seed + species_id) % 2 = 0 THEN value * 2 END FROM fx_seed_metric)"


def two_metrics(t):
    rows = t.fx_seed_metric.select("species_id", "seed", "value")
    even = F.when((F.col("seed") + F.col("species_id")) % 2 == 0, F.col("value") * 2)
    return rows.withColumn("metric", F.lit("plain")).unionByName(rows.withColumn("value", even).withColumn("metric", F.lit("even")))


@query("e2_macro_per_metric", f"""WITH {TWO_METRICS}, good AS (SELECT * FROM tm WHERE value IS NOT NULL),
c AS (SELECT metric, species_id FROM good GROUP BY ALL HAVING count(DISTINCT seed) = 5),
s AS (SELECT 'union' AS species_set, * FROM good UNION ALL SELECT 'common', good.* FROM good JOIN c ON c.metric = good.metric AND c.species_id = good.species_id),
p AS (SELECT metric, species_set, seed, avg(value) AS m, median(value) AS md FROM s GROUP BY ALL)
SELECT metric, species_set, round(avg(m), 6) AS mean, round(CASE WHEN count(*) >= 2 THEN stddev_pop(m) END, 6) AS mean_std, round(avg(md), 6) AS median,
 round(CASE WHEN count(*) >= 2 THEN stddev_pop(md) END, 6) AS median_std, count(*) AS n_seeds FROM p GROUP BY ALL""", "fx_seed_metric")
def _(t):
    return E.macro_over_seeds(two_metrics(t), 5, ["metric"]).withColumns(r6("mean", "mean_std", "median", "median_std"))


@query("e3_coverage_per_metric", f"""WITH {TWO_METRICS}, m AS (SELECT DISTINCT metric FROM tm)
SELECT metric, n_seeds, count(*) AS n_species FROM (SELECT m.metric, s.species_id, count(DISTINCT CASE WHEN value IS NOT NULL THEN seed END) AS n_seeds
 FROM fx_species s CROSS JOIN m LEFT JOIN tm ON s.species_id = tm.species_id AND tm.metric = m.metric GROUP BY ALL) GROUP BY ALL""", "fx_species fx_seed_metric")
def _(t):
    return E.seed_coverage(two_metrics(t), t.fx_species, ["metric"])


GRID = (0.5, 1.0, 2.0, 4.0, 8.0)
# the five seeds stand for five grid values
PARAM_RUNS = """runs AS (SELECT species_id, [0.5E0, 1, 2, 4, 8][seed + 1] AS param, seed, round(value, 3) AS value FROM fx_seed_metric)"""


def param_runs(t: Inputs) -> DataFrame:
    grid = F.array(*[F.lit(g) for g in GRID])
    return t.fx_seed_metric.select("species_id", F.get(grid, F.col("seed")).alias("param"), F.round("value", 3).alias("value"))


PICKED = """picked AS (SELECT species_id, param, value AS score FROM (SELECT *, row_number() OVER (PARTITION BY species_id ORDER BY value DESC, seed) AS k
 FROM runs WHERE value IS NOT NULL) WHERE k = 1)"""


@query("e4_select_hyperparameter", f"WITH {PARAM_RUNS}, {PICKED} SELECT * FROM picked", "fx_seed_metric")
def _(t):
    return E.select_hyperparameter(param_runs(t), GRID)


@query("e5_selection_distribution", f"""WITH {PARAM_RUNS}, {PICKED} SELECT param, count(*) AS n_species, round(count(*) / CAST((SELECT count(*) FROM picked) AS DOUBLE), 6) AS share,
 (SELECT count(*) FILTER (WHERE param IN (0.5, 8)) * 2 > count(*) FROM picked) AS mostly_at_ends FROM picked GROUP BY param""", "fx_seed_metric")
def _(t):
    return E.selection_distribution(E.select_hyperparameter(param_runs(t), GRID), GRID).withColumns(r6("share"))


@query("e6_training_time_summary", """SELECT round(sum(train_time_seconds), 6) AS total_seconds, round(sum(train_time_seconds) / 3600, 6) AS total_hours,
 count(DISTINCT species_id) AS species_timed, round(sum(train_time_seconds) / count(DISTINCT species_id), 6) AS mean_seconds_per_species
 FROM fx_training_time WHERE train_time_seconds IS NOT NULL""", "fx_training_time")
def _(t):
    return E.training_time_summary(t.fx_training_time).withColumns(r6("total_seconds", "total_hours", "mean_seconds_per_species"))


@query("e7_model_score", f"{scores()} SELECT a.species_id, 'auroc' AS metric, round(auroc, 6) AS value, species_name FROM auroc a JOIN fx_species s ON a.species_id = s.species_id", ALL_VIEWS)
def _(t):
    return E.model_score(long_metrics(t), t.fx_species, "auroc", at_once=False).withColumns(r6("value"))


@query("e8_needs_evaluation", """SELECT species_id FROM fx_species WHERE species_id NOT IN (SELECT species_id FROM fx_seed_metric WHERE seed = 3 AND value IS NOT NULL)""", "fx_species fx_seed_metric")
def _(t):
    return E.needs_evaluation(t.fx_species, t.fx_seed_metric.where("seed = 3"))


@query("e8_missing_models", """SELECT species_id FROM fx_species WHERE species_id NOT IN (SELECT label FROM embeddings)""", "fx_species")
def _(t):
    return E.missing_models(t.fx_species, t.fx_feature)


# ---- sources and sinks ----


# each order has at most a few suppliers; the wide table has one column per discount value
WIDE = """wide AS (SELECT l_orderkey AS location_id, max(8.0E0) AS lon, max(46.0E0) AS lat, max(l_discount) * 10 AS sp_a, max(l_tax) * 10 AS sp_b,
 least(1.0E0, max(l_extendedprice) / 1.1E5) AS sp_c, max(l_quantity) / 100 AS sp_d FROM {lineitem} GROUP BY l_orderkey)"""


@query("s6_read_predictions", "WITH " + WIDE.format(lineitem="lineitem") + """ SELECT location_id, 0 AS species_id, round(sp_a, 6) AS probability FROM wide
UNION ALL SELECT location_id, 1, round(sp_b, 6) FROM wide UNION ALL SELECT location_id, 2, round(sp_c, 6) FROM wide UNION ALL SELECT location_id, 3, round(sp_d, 6) FROM wide""")
def _(t):
    return P.read_wide(t.sql("WITH " + WIDE + " SELECT * FROM wide")).withColumns(r6("probability"))


@query("s7_validate_predictions", """SELECT count(*) AS n_rows, count(DISTINCT p.species_id) AS n_species,
 count(*) FILTER (WHERE probability IS NULL) AS n_not_finite, count(*) FILTER (WHERE probability > 1 + 1e-6 OR probability < -1e-6) AS n_out_of_range,
 (SELECT count(*) FROM fx_presence q WHERE NOT EXISTS (SELECT 1 FROM fx_prediction r WHERE r.location_id = q.location_id AND r.species_id = q.species_id)) AS n_truth_only,
 (SELECT count(*) FROM fx_prediction r WHERE NOT EXISTS (SELECT 1 FROM fx_presence q WHERE r.location_id = q.location_id AND r.species_id = q.species_id)) AS n_pred_only,
 count(*) FILTER (WHERE probability IS NULL OR probability > 1 + 1e-6 OR probability < -1e-6) = 0 AND count(DISTINCT p.species_id) = (SELECT count(*) FROM fx_species) AS valid
 FROM fx_prediction p""", "fx_prediction fx_presence fx_species")
def _(t):
    n = t.fx_species.agg(F.count("*")).scalar()
    return P.validate(t.fx_prediction, n, t.fx_presence)


@query("s8_attach_truth", """SELECT p.location_id, p.species_id, coalesce(nullif(p.label, -1), CASE WHEN q.species_id IS NOT NULL THEN 1 END) AS label
 FROM fx_prediction p LEFT JOIN fx_presence q ON p.location_id = q.location_id AND p.species_id = q.species_id""", "fx_prediction fx_presence")
def _(t):
    pred = t.fx_prediction.withColumn("label", F.nullif("label", F.lit(-1)))
    return P.attach_truth(pred, t.fx_presence.withColumn("label", F.lit(1))).select("location_id", "species_id", "label")


@query("s9_targets_round_trip", "SELECT location_id, species_id, 1 AS value FROM fx_presence", "fx_presence")
def _(t):
    path = out_dir(t) + "/targets"
    S.save_targets(t.lineitem.select(F.col("l_orderkey").alias("location_id"), F.col("l_suppkey").alias("species_id")), path)
    return S.load_targets(t.spark, path).select("location_id", "species_id", "value")


@query("s9_target_shape", """SELECT (SELECT count(*) FROM orders) AS n_rows, (SELECT count(*) FROM supplier) AS n_species, count(*) AS n_presences FROM fx_presence""", "fx_presence")
def _(t):
    return S.target_shape(t.fx_presence, t.fx_location, t.fx_species)


@query("s10_species_index", "SELECT species_id, location_id, row_number() OVER (ORDER BY species_id, location_id) - 1 AS slot FROM fx_presence", "fx_presence")
def _(t):
    return S.species_index(t.fx_presence)[0]


@query("s10_species_lookup", """SELECT species_id, CAST(sum(n) OVER (ORDER BY species_id) - n AS BIGINT) AS first_slot, n FROM
 (SELECT species_id, count(*) AS n FROM fx_presence GROUP BY 1)""", "fx_presence")
def _(t):
    return S.species_index(t.fx_presence)[1]


@query("s11_species_dictionary", """SELECT p_name AS species_name, row_number() OVER (ORDER BY p_name) - 1 AS species_id FROM (SELECT DISTINCT p_name FROM part)""")
def _(t):
    return S.species_dictionary(t.part.select(F.col("p_name").alias("species_name")))


@query("s12_species_metrics_table", f"""{scores()} SELECT s.species_id, species_name, round(auroc, 6) AS auroc, round(auprg, 6) AS auprg
 FROM fx_species s LEFT JOIN auroc USING (species_id) LEFT JOIN auprg USING (species_id)""", ALL_VIEWS)
def _(t):
    return S.species_metrics_table(long_metrics(t), t.fx_species, ("auroc", "auprg")).withColumns(r6("auroc", "auprg"))


@query("s13_merge_job_metrics", """SELECT species_id, 'auroc' AS metric, arg_max(value, seed) AS value FROM fx_seed_metric WHERE value IS NOT NULL GROUP BY 1""", "fx_seed_metric")
def _(t):
    return E.merge_job_metrics(t.fx_seed_metric.select("species_id", F.lit("auroc").alias("metric"), "value", F.col("seed").alias("job_order")))


@query("s14_merge_job_predictions", """SELECT s.species_id, p.location_id, p.probability FROM fx_species s LEFT JOIN
 (SELECT * FROM fx_prediction p JOIN fx_species q ON p.species_id = q.species_id WHERE home_area < 10 OR home_area >= 15) p ON s.species_id = p.species_id""", "fx_species fx_prediction")
def _(t):
    homes = t.fx_prediction.select("species_id", "location_id", "probability").join(t.fx_species.select("species_id", "home_area"), "species_id")
    slices = [homes.where("home_area < 10").drop("home_area"), homes.where("home_area >= 15").drop("home_area")]
    return E.merge_job_predictions(slices, t.fx_species, t.n_rows("lineitem"))


@query("s15_merge_training_times", """SELECT species_id, arg_min(part_no, (part_no, row_order)) AS part_no, first(train_time_seconds ORDER BY part_no, row_order) AS train_time_seconds
 FROM fx_training_time GROUP BY species_id""", "fx_training_time")
def _(t):
    return E.merge_training_times(t.fx_training_time)


@query("s15_training_time_status", """SELECT count(s) AS n_ok, count(*) - count(s) AS n_failed FROM (SELECT first(train_time_seconds ORDER BY part_no, row_order) AS s FROM fx_training_time GROUP BY species_id)""", "fx_training_time")
def _(t):
    return E.training_time_status(E.merge_training_times(t.fx_training_time))


@query("s16_copy_shared_columns", """SELECT s.s_suppkey AS species_id, s.s_name AS species_name, coalesce(a.v, b.v) AS growth, b.w AS extra FROM supplier s
 LEFT JOIN (SELECT l_suppkey AS k, min(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' AND l_tax = 0 GROUP BY 1) a ON s.s_suppkey = a.k
 LEFT JOIN (SELECT l_suppkey AS k, max(l_quantity) AS v, max(l_tax) AS w FROM lineitem GROUP BY 1) b ON s.s_suppkey = b.k""")
def _(t):
    li = t.lineitem.withColumnRenamed("l_suppkey", "species_id")
    a = li.where("l_returnflag = 'R' and l_tax = 0").groupBy("species_id").agg(F.min("l_quantity").alias("growth"))
    b = li.groupBy("species_id").agg(F.max("l_quantity").alias("growth"), F.max("l_tax").alias("extra"))
    return E.copy_shared_columns(t.fx_species.select("species_id", "species_name"), [a, b], ["growth", "extra"])


@query("s18_prediction_table", """SELECT 'base' AS run, 2 AS seed, location_id, species_id, probability, label FROM masked""", PRED_VIEWS)
def _(t):
    return P.prediction_table(t.in_range_prediction, t.fx_location, "base", 2)[0]


@query("s18_prediction_locations", """SELECT location_id, lon, lat, CASE WHEN (SELECT count(*) = count(sampled_area_m2) FROM fx_location WHERE location_id IN (SELECT location_id FROM fx_presence)) THEN sampled_area_m2 END AS sampled_area_m2
 FROM fx_location WHERE location_id IN (SELECT location_id FROM fx_presence)""", "fx_location fx_presence")
def _(t):
    return P.prediction_table(t.in_range_prediction, t.fx_location, "base", 2)[1]


# raw files: the driver tables written out as text and read back by the readers


@query("s1_read_occurrences", """SELECT species_id, location_id, uncertainty_m, basis_of_record FROM fx_occurrence""", "fx_occurrence")
def _(t):
    path = out_dir(t) + "/occurrences"
    raw = t.fx_occurrence.select(
        F.col("species_id").cast("string").alias("scientificName"), F.lit(None).cast("double").alias("decimalLongitude"),
        F.lit(None).cast("double").alias("decimalLatitude"), F.lit(None).cast("string").alias("countryCode"),
        F.lit(None).cast("int").alias("individualCount"), F.col("location_id").alias("gbifID"),
        F.lit(None).cast("string").alias("family"), F.lit("SPECIES").alias("taxonRank"),
        F.col("uncertainty_m").alias("coordinateUncertaintyInMeters"), F.lit(2000).alias("year"),
        F.col("basis_of_record").alias("basisOfRecord"), F.lit(None).cast("string").alias("institutionCode"),
        F.lit(None).cast("string").alias("datasetKey"))
    raw.write.option("sep", "\t").option("header", True).csv(path)
    return S.read_occurrences(t.spark, path).select(
        F.col("species").cast("bigint").alias("species_id"), F.col("gbifID").alias("location_id"),
        F.col("coordinateUncertaintyInMeters").alias("uncertainty_m"), F.col("basisOfRecord").alias("basis_of_record"))


@query("s2_write_by_species", """SELECT species_id AS species, count(*) AS n, CAST(sum(location_id) AS BIGINT) AS checksum FROM fx_occurrence GROUP BY 1""", "fx_occurrence")
def _(t):
    path = out_dir(t) + "/by_species"
    S.write_by_species(t.fx_occurrence.withColumn("species", F.col("species_id").cast("string")).drop("species_id"), path)
    back = t.spark.read.parquet(path)
    return back.groupBy(F.col("species").cast("bigint").alias("species")).agg(F.count("*").alias("n"), F.sum("location_id").alias("checksum"))


@query("s3_read_plots", """SELECT l.location_id, l.species_id, plot_quality, sampled_area_m2 FROM fx_presence l JOIN fx_location o ON l.location_id = o.location_id""", "fx_presence fx_location")
def _(t):
    path = out_dir(t)
    w = {"sep": "\t", "header": True, "encoding": "ISO-8859-1"}
    t.fx_presence.withColumnRenamed("location_id", "PlotObservationID").write.options(**w).csv(path + "/plots")
    t.fx_location.select(F.col("location_id").alias("PlotObservationID"), "plot_quality", "sampled_area_m2").write.options(**w).csv(path + "/header")
    plots = S.read_plots(t.spark, path + "/plots", "PlotObservationID bigint, species_id bigint")
    header = S.read_plots(t.spark, path + "/header", "PlotObservationID bigint, plot_quality string, sampled_area_m2 double")
    return S.join_plots(plots, header).withColumnRenamed("PlotObservationID", "location_id")


@query("s4_read_checklist", "SELECT plant_name_id, taxon_name, taxon_status, taxon_authors FROM fx_checklist", "fx_checklist")
def _(t):
    path = out_dir(t) + "/names"
    t.fx_checklist.write.option("sep", "|").option("header", True).option("quote", "").csv(path)
    return S.read_checklist(t.spark, path, "plant_name_id bigint, taxon_name string, taxon_status string, taxon_authors string")


@query("s5_concat_species_files", "SELECT location_id, basis_of_record, species_id FROM fx_occurrence", "fx_occurrence")
def _(t):
    path = out_dir(t) + "/cleaned"
    S.write_by_species(t.fx_occurrence.drop("uncertainty_m"), path, key="species_id")
    return S.concat_species_files(t.spark, path).select("location_id", "basis_of_record", F.col("species_id").cast("bigint").alias("species_id"))


@query("s17_ingest_increment", """SELECT event_type AS species, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def _(t):
    from florapark.streaming.ingest import ingest, read_increments

    path = out_dir(t)
    source = t.events.select(F.col("event_type").alias("species"), "event_id", "value")
    source.repartition(6, "event_id").write.parquet(path + "/in")
    stream = read_increments(t.spark, path + "/in", source.schema, maxFilesPerTrigger="2")
    job = ingest(stream, path + "/out", path + "/state")
    job.awaitTermination()
    back = t.spark.read.parquet(path + "/out")
    return back.groupBy("species").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
