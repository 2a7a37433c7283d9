"""Partitions that follow the rows, so that a task's memory does not follow the table."""

import pytest
from compare import connect, problem
from florapark.operators import cleaning as C, ranking
from florapark.operators.ranking import ROWS_PER_TASK, spread
from pyspark.sql import functions as F


def test_partitions_follow_the_rows(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 100)
    cores = spark.sparkContext.defaultParallelism
    assert spread(df, cores * ROWS_PER_TASK, "k") is df
    for times in (2, 20):
        wide = spread(df, times * cores * ROWS_PER_TASK, "k")
        assert wide.rdd.getNumPartitions() == times * cores
        assert wide.groupBy("k").count().rdd.getNumPartitions() == times * cores


def test_duplicates_need_one_shuffle(spark):
    rows = [(1, 8.0, 46.0, 5), (1, 8.0, 46.0, 3), (1, 8.0, 46.0, 3), (1, 8.5, 46.0, 9), (2, 8.0, 46.0, 4), (2, None, 46.0, 1), (3, 8.0, 46.0, None), (3, 8.0, 46.0, 2)]
    occ = spark.createDataFrame(rows, "species_id int, lon double, lat double, record int")
    out = C.flag_duplicates(occ, ["species_id", "lon", "lat"], "record")
    assert sorted(map(repr, out.collect())) == sorted(map(repr, [
        out.collect()[0].__class__(species_id=s, lon=x, lat=y, record=r, ok_duplicates=ok) for (s, x, y, r), ok in zip(
            rows, [False, True, True, True, True, None, None, True])]))
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


@pytest.mark.parametrize("name", ["f7_flag_duplicates", "f10_flag_summary", "f10_passing_records", "s14_merge_job_predictions", "g16_mask_rank", "g30_shared_rescale"])
def test_spread_tables_give_the_same_rows(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_TASK", 300)
    assert problem(spark, connect(sf_dir), sf_dir, name) is None
