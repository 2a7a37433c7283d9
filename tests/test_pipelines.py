"""Chains of operators as one call."""

import random

import numpy as np
import pytest
from florapark.plans import pipelines as PL
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    locations = spark.createDataFrame([(i, i % 3) for i in range(90)], "location_id bigint, area_code int")
    species = spark.createDataFrame([(0, "a"), (1, "b")], "species_id int, species_name string")
    ranges = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2)], "species_id int, area_code int")
    truth = [(i, s, int(rng.random() < 0.3)) for i in range(90) for s in (0, 1)]
    presence = spark.createDataFrame([(i, s) for i, s, y in truth if y], "location_id bigint, species_id int")
    wide = [(i, 8.0, 46.0, round(rng.random(), 2), round(rng.random(), 2)) for i in range(90)]
    return {
        "locations": locations, "species": species, "ranges": ranges, "presence": presence, "rows": truth, "cells": wide,
        "truth": spark.createDataFrame(truth, "location_id bigint, species_id int, label int"),
        "wide": spark.createDataFrame(wide, "location_id bigint, lon double, lat double, a double, b double"),
    }


def call(t, pred, **kw):
    return PL.evaluate_predictions(pred, t["locations"], t["species"], t["ranges"], t["presence"], truth=t["truth"], **kw)


def test_evaluation_of_a_wide_table_equals_pairs_counted_by_hand(tables):
    got = call(tables, tables["wide"], reference=tables["wide"].withColumns({"a": F.lit(0.5), "b": F.lit(0.5)}), names=("auroc", "f1"))
    inside = {0: (0, 1), 1: (1, 2)}
    value = {(i, s): row[3 + s] for row in tables["cells"] for s in (0, 1) for i in [row[0]]}
    want = {}
    for s in (0, 1):
        used = [(value[(i, s)], y) for i, z, y in tables["rows"] if z == s and i % 3 in inside[s]]
        pos, neg = [v for v, y in used if y], [v for v, y in used if not y]
        want[s] = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    scores = {r["species_id"]: r["value"] for r in got.metrics.where("metric = 'auroc'").collect()}
    assert scores == pytest.approx(want)
    deltas = {r["species_id"]: r["delta"] for r in got.deltas.where("metric = 'auroc'").collect()}
    assert deltas == pytest.approx({s: v - 0.5 for s, v in want.items()})
    assert got.validation.first()["valid"] and got.report.count() == 16


def test_strict_evaluation_raises_when_read(tables):
    bad = tables["wide"].withColumn("a", F.when(F.col("location_id") == 3, 1.5).otherwise(F.col("a")))
    done = call(tables, bad)
    with pytest.raises((PySparkException, Py4JError), match="failed validation"):
        done.metrics.collect()
    loose = call(tables, bad, strict=False)
    assert loose.metrics.count() == 4 and not loose.validation.first()["valid"] and loose.deltas is None
    with pytest.raises((PySparkException, Py4JError), match="failed validation"):
        call(tables, tables["wide"].drop("b")).report.collect()


def test_block_products_score_each_cell_in_range(spark, monkeypatch):
    monkeypatch.setattr(PL, "CELL_BLOCK", 7)
    monkeypatch.setattr(PL, "SPECIES_BLOCK", 2)
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(40, 3)), rng.normal(size=(5, 3))
    cells = spark.createDataFrame([(i // 20, i, [float(v) for v in x[i]]) for i in range(40)],
                                  "area_code int, flat_index bigint, features array<double>")
    model = spark.createDataFrame([(s, 0.1 * s, [float(v) for v in w[s]], "ok" if s != 4 else "no presences") for s in range(5)],
                                  "species_id int, intercept double, coefficients array<double>, status string")
    ranges = spark.createDataFrame([(s, 0) for s in range(5)] + [(2, 1), (2, 1), (9, 1)], "species_id int, area_code int")
    rows = PL.score_by_area(cells, model, ranges).collect()
    got = {(r["species_id"], r["flat_index"]): r["probability"] for r in rows}
    want = {(s, i): 1 / (1 + np.exp(-(0.1 * s + x[i] @ w[s]))) for s in range(4) for i in range(40) if i < 20 or s == 2}
    assert len(rows) == len(got) and got == pytest.approx(want)
    assert PL.score_by_area(cells, model.limit(0), ranges).count() == 0
