"""Training rows that stay together from the draw to the fit."""

import numpy as np
import pytest
from florapark.operators import fitting, models as L, sampling as S, trees
from florapark.plans import modelling
from florapark.plans.inputs import Inputs
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def plots(spark):
    presence = spark.range(9_000).selectExpr("cast(id % 7 as int) species_id", "(id * 131 + id % 7 * 17) % 30000 location_id").where("species_id <> 5 or location_id % 40 = 0")
    locations = spark.range(30_000).selectExpr("id location_id", "cast(id % 3 as int) area_code")
    ranges = spark.createDataFrame([(s, a) for s in range(7) for a in range(3) if (s + a) % 4], "species_id int, area_code int")
    x = spark.range(30_000).where("id % 11 <> 3").selectExpr("id location_id", "array(sin(id), cast(id % 5 as double)) predictors")
    return presence, locations, ranges, x


@pytest.mark.parametrize("model", ["glm", "logistic"])
def test_packed_rows_are_those_of_the_draw(spark, plots, monkeypatch, model):
    monkeypatch.setattr(S, "SLOT_CHUNK", 512)  # stretches over many chunks
    *draw, x = plots
    want = S.presence_background(*draw, model, None, seed=2).join(x, "location_id")
    got = S.training_table(*draw, x, model, None, seed=2)
    columns = ["species_id", "location_id", "label", "predictors"]
    rows = lambda d: sorted((r[0], r[1], r[2], tuple(r[3])) for r in d.select(*columns).collect())
    assert rows(fitting.unpacked(got)) == rows(want)
    assert got.where((F.size("keys") != F.col("n")) | (F.size("xs") != F.col("n") * F.col("p"))).isEmpty()
    background = got.where("label = 0")
    if model == "glm":  # every eleventh location has no predictors
        assert 4 * background.count() < background.agg(F.sum("n")).first()[0]


@pytest.mark.parametrize("local", [1 << 15, 1000])
def test_packed_rows_are_fitted_and_checked_like_single_ones(spark, plots, monkeypatch, local):
    monkeypatch.setattr(fitting, "LOCAL_ROWS", local)
    monkeypatch.setattr(fitting, "SLICE_ROWS", local)
    *draw, x = plots
    table = L.presence_background_weights(S.training_table(*draw, x, "glm", None, seed=2, pool=2_000), "glm")
    single = L.presence_background_weights(S.presence_background(*draw, "glm", None, seed=2, pool=2_000).join(x, "location_id"), "glm")
    if local == 1000:  # a Spark pass per round
        table, single = (d.where("species_id = 1") for d in (table, single))
    spec = L.Linear(l2=1.0)
    of = lambda d: {r["species_id"]: r for r in d.collect()}
    one, two = L.fit_linear(table, spec, "predictors"), L.fit_linear(single, spec, "predictors")
    a, b = of(one), of(two)
    assert a.keys() == b.keys() and len(a) > (0 if local == 1000 else 4)
    for s in a:
        assert (a[s]["n_samples"], a[s]["n_presences"], a[s]["n_features"], a[s]["status"]) == (b[s]["n_samples"], b[s]["n_presences"], 2, "ok")
        assert max(abs(u - v) for u, v in zip([a[s]["intercept"], *a[s]["coefficients"]], [b[s]["intercept"], *b[s]["coefficients"]])) < 1e-9
    held = of(L.linear_residuals(table, one, spec, "predictors"))
    assert held.keys() == a.keys() and all(r["worst"] < 1e-3 and abs(r["balance"]) < 1e-3 for r in held.values())


def test_first_split_writes_no_row_per_species_and_location(spark, sf_dir, monkeypatch):
    written, pin = [], S.pin
    for module in (S, fitting, trees, modelling):
        monkeypatch.setattr(module, "pin", lambda d: written.append(pin(d)) or written[-1])
    n = modelling.coarse_rows(Inputs(spark, sf_dir), "randomforest").agg(F.sum("n")).first()[0]
    assert sum(w.count() for w in written if "label" in w.columns) == 0 and n > 5_000
    assert all(w.count() < n for w in written)


def test_splines_are_those_of_the_full_basis_and_worked_out_once_per_group(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=500), rng.integers(0, 9, 500)])
    x[4, 0] = np.nan
    lo, hi = np.array([-1.5, 0.0]), np.array([2.0, 8.0])  # rows beyond the range, on its ends and on knots
    spec = L.Linear(smooth=0.6, l2=1e-3, n_splines=12, expand="splines")
    at = (np.clip(x, lo, hi) - lo) / ((hi - lo) / 9)
    u = np.abs(at[:, :, None] - np.arange(-1, 11))
    want = np.where(u < 1, (4 - 6 * u**2 + 3 * u**3) / 6, np.where(u < 2, (2 - u) ** 3 / 6, 0.0)).reshape(500, -1)
    assert np.allclose(L.expansion(spec, lo, hi, x), want, atol=1e-15) and (want[4, :12] == 0).all()
    calls, expansion = [], L.expansion
    monkeypatch.setattr(L, "expansion", lambda *a: calls.append(1) or expansion(*a))
    x[4, 0] = 0.0
    block = fitting.Block(np.arange(500), x, (rng.random(500) < 0.4).astype(float), np.ones(500), np.zeros(500))
    for param in (0.1, 1.0):
        block.memo = {}
        method, done, rounds = L.LinearMethod(spec, lambda s, v: L.replace(s, smooth=v)), False, 0
        s = method.begin({"param": param, "lo": lo, "hi": hi})
        while not done:
            rounds += 1
            s, done = method.solve(s, method.step(s, block), rounds)
    assert rounds > 3 and len(calls) == 1


def test_rows_are_held_out_in_the_task_of_their_species(spark, plots, monkeypatch):
    *draw, x = plots
    single = S.presence_background(*draw, "brt", None, seed=2, pool=1_500).join(x, "location_id")
    want = {(r[0], r[1]): float(r[2]) for r in S.stratified_holdout(single, 0.2, 3).select("species_id", "location_id", "holdout").collect()}
    for species in (1, 5):
        rows = single.where(F.col("species_id") == species).orderBy("location_id").select("location_id", "label").collect()
        n = len(rows)
        block = fitting.Block(np.array([r[0] for r in rows]), np.zeros((n, 1)), np.array([float(r[1]) for r in rows]), np.ones(n), np.zeros(n))
        assert fitting.held_out(block, species, 0.2, 3).tolist() == [want[species, r[0]] for r in rows]
    one = fitting.Block(np.arange(5), np.zeros((5, 1)), np.array([1.0, 0, 0, 0, 0]), np.ones(5), np.zeros(5))
    assert fitting.held_out(one, 1, 0.2, 3).sum() == 0  # a class of one row is not split

    def never(*_):
        raise AssertionError("rows of small species are ranked by a shuffle")

    monkeypatch.setattr(fitting, "stratified_holdout", never)
    log, model = trees.fit_boosted(S.training_table(*draw, x, "brt", None, seed=2, pool=200), trees.Boosted(trees=3, patience=2))
    assert log.where("n_trees >= 0").count() == model.count() > 4
