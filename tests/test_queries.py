"""Every registered query against its check SQL, and plan rules that hold for all of them."""

import re

import pytest
from compare import connect, problem
from florapark.plans.catalog import CHECKS, QUERIES

# their scores depend on a fit; what must hold of each fit is a query of its own
FITS = ("l2_logistic", "l3_glm", "l4_random_forest", "l5_boosted_trees", "l5_brt", "l6_gam", "l7_maxent", "l8_linear_multi_species")
CHECKED = sorted(n for n in QUERIES if n in CHECKS)


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    assert problem(spark, duck, sf_dir, name) is None


def test_only_fits_go_without_check():
    assert {n for n in QUERIES if n not in CHECKS} == set(FITS)


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", ["m5_compute_metrics", "k7_moving_window_grid", "g13_assign_area", "g22_fill_nodata_nearest",
                                  "g24_nearest_background", "g29_rescale_linear", "t4_match_fuzzy", "f8_near_reference",
                                  "p4_presence_background", "p7_stratified_split", "x10_loss_denominators"])
def test_no_cross_join(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = QUERIES["r5_species_observed"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("l_quantity" not in s and "l_extendedprice" not in s for s in schemas)


def test_bbox_reaches_the_scan(spark, tmp_path):
    from florapark.operators.cleaning import bbox_filter

    path = str(tmp_path / "points")
    spark.range(10).selectExpr("id", "id * 1.0D AS lon", "id * 2.0D AS lat").write.parquet(path)
    plan = bbox_filter(spark.read.parquet(path), 1, 1, 5, 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lon,1.0)" in plan and "LessThanOrEqual(lon,5.0)" in plan
