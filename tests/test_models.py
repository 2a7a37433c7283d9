"""Fitted models against direct solutions and known signals."""

import numpy as np
import pytest
from florapark.operators import fitting, layer, maxent, models as L, trees
from florapark.operators import weights as W
from florapark.operators.metrics import compute_metrics
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data(spark):
    """Three species: a linear signal, a bump, and one without presences; a third of all rows belong to species 1."""
    rng = np.random.default_rng(0)
    rows = []
    for s, n in ((1, 900), (2, 600), (3, 40)):
        x = rng.normal(size=(n, 3))
        if s == 1:
            y = rng.random(n) < 1 / (1 + np.exp(-(0.5 + 1.5 * x[:, 0] - x[:, 1])))
        elif s == 2:
            y = np.abs(x[:, 0]) < 0.6
        else:
            y = np.zeros(n, bool)
        rows += [(s, i, int(b), 1.0, [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "species_id bigint, location_id bigint, label int, weight double, features array<double>").cache()


def newton(x, y, l2):
    m, s = x.mean(0), x.std(0)
    z = np.hstack([np.ones((len(y), 1)), (x - m) / s])
    b = np.zeros(z.shape[1])
    pen = np.diag([0.0] + [l2] * x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (mu * (1 - mu))[:, None]).T @ z + pen, z.T @ (mu - y) + pen @ b)
    return b[0] - (b[1:] / s) @ m, b[1:] / s


def test_logistic_equals_a_direct_solution(spark, data, monkeypatch):
    monkeypatch.setattr(fitting, "BLOCK_ROWS", 64)  # many blocks per species
    got = {r["species_id"]: r for r in L.fit_linear(data, L.Linear(l2=1.0)).collect()}
    for s in (1, 2):
        rows = data.where(F.col("species_id") == s).toPandas()
        a, b = newton(np.vstack(rows["features"]), rows["label"].to_numpy(float), 1.0)
        assert got[s]["status"] == "ok"
        assert np.allclose(got[s]["coefficients"], b, atol=1e-4) and abs(got[s]["intercept"] - a) < 1e-4
    assert got[3]["status"] == "no presences" and got[1]["n_samples"] == 900


def test_lasso_drops_noise(spark, data):
    got = {r["species_id"]: r for r in L.fit_linear(data, L.Linear(l1=60.0)).collect()}
    c = got[1]["coefficients"]
    assert c[0] > 0 > c[1] and c[2] == 0.0


def auroc(table, species):
    return compute_metrics(table, ("auroc",)).where(F.col("species_id") == species).first()["auroc"]


@pytest.mark.parametrize("name,options", [("gam", {}), ("glm", {}), ("maxent", {"classes": "lq"}),
                                          ("gradientboosting", {"trees": 8, "depth": 2}), ("randomforest", {"trees": 8, "max_features": 3})])
def test_models_learn_the_bump(spark, data, name, options):
    train = data.withColumnRenamed("features", "predictors").drop("weight")
    rows = train.withColumn("split", F.lit("train"))
    fitted, predictions, metrics = L.fit_predict_many(train, rows, name, **options)
    assert auroc(predictions, 2) > 0.9
    assert metrics.where("species_id = 3 AND auroc IS NOT NULL").count() == 0
    log = {r["species_id"]: r for r in fitted.collect()}
    assert log[3]["status"] == "no presences" and log[3]["seconds"] == 0 and log[2]["seconds"] > 0 and log[2]["n_samples"] == 600


def test_forest_scoring_follows_the_trees(spark, data):
    _, model = trees.fit_forest(data, trees.Forest(trees=3, max_features=3, depth=4), "features")
    model = model.cache()
    scored = {(r["species_id"], r["location_id"]): r["probability"] for r in trees.score_forest(model, data, "features").collect()}
    grown = {}
    for r in model.collect():
        grown.setdefault(r["species_id"], []).append(np.asarray(r["nodes"]).reshape(-1, 5))
    for r in data.where("location_id < 20 AND species_id < 3").collect():
        votes = []
        for t in grown[r["species_id"]]:
            at = 0
            while t[at][0] >= 0:
                at = int(t[at][2] if r["features"][int(t[at][0])] <= t[at][1] else t[at][3])
            votes.append(t[at][4])
        assert abs(np.mean(votes) - scored[(r["species_id"], r["location_id"])]) < 1e-12


def test_fits_that_ran_out_of_rounds_are_scored(spark, data):
    model = L.fit_linear(data, L.Linear(l2=1.0, rounds=1))
    status = {r["species_id"]: r["status"] for r in model.collect()}
    assert status == {1: "not converged", 2: "not converged", 3: "no presences"}
    assert {r["species_id"] for r in L.score_linear(model, data).select("species_id").distinct().collect()} == {1, 2}


def test_deep_trees_are_followed_to_their_leaves(spark):
    rows = [(1, i, i % 2, 1.0, [float(i)]) for i in range(120)]
    data = spark.createDataFrame(rows, "species_id bigint, location_id bigint, label int, weight double, features array<double>")
    # all rows in the tree, an edge between any two values
    _, model = trees.fit_forest(data, trees.Forest(trees=1, max_features=1, depth=200, min_leaf=1, bins=240, bootstrap=False), "features")
    assert model.first()["depth"] > 5
    scored = trees.score_forest(model, data, "features")
    assert scored.where((F.col("probability") - F.col("label")) != 0).count() == 0


def test_workers_need_not_start_in_the_package_folder(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "job.py").write_text(f"""
import sys
sys.path.insert(0, {root!r})
from florapark.operators import models as L, trees
from florapark.session import local_session
spark = local_session(2)
rows = [(1, i, i % 2, 1.0, [float(i % 7)]) for i in range(60)]
data = spark.createDataFrame(rows, "species_id bigint, location_id bigint, label int, weight double, features array<double>")
print("FITTED", L.fit_linear(data, L.Linear(l2=1.0)).count(), trees.fit_forest(data, trees.Forest(trees=2), "features")[1].count())
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "job.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FITTED 1 2" in done.stdout, done.stderr[-2000:]


def test_boosted_cuts_follow_a_skewed_predictor(spark):
    rng = np.random.default_rng(1)
    x = np.r_[rng.random(396), [1e6] * 4]
    rows = [(1, i, int(v > 0.5), 1.0, [float(v), float(-v)]) for i, v in enumerate(x)]
    data = spark.createDataFrame(rows, "species_id bigint, location_id bigint, label int, weight double, features array<double>")
    log, model = trees.fit_boosted(data, trees.Boosted(trees=3), "features")
    assert auroc(trees.score_boosted(model, data, "features"), 1) > 0.95 and log.first()["n_features"] == 2


def test_queries_fit_at_the_operators_parameters(monkeypatch):
    from florapark.plans import modelling

    seen = []
    monkeypatch.setattr(modelling, "train_and_evaluation", lambda t, model: (None, None))
    monkeypatch.setattr(modelling.L, "fit_predict_many", lambda *a, **options: seen.append((a[2], options)) or (_ for _ in ()).throw(KeyError))
    monkeypatch.setattr(modelling, "query", lambda name: lambda f: pytest.raises(KeyError, f, None))
    source = open(modelling.__file__).read()
    for line in source.split("\n"):
        if line.startswith(('register_fit("l4', 'register_fit("l5')):
            eval(line, vars(modelling))
    assert seen == [("randomforest", {}), ("gradientboosting", {}), ("brt", {})]


def test_unknown_model(spark):
    with pytest.raises(ValueError, match="maxent"):
        L.get_model("perceptron")


# ---- the same fit in one task and by rounds over the cluster ----


@pytest.fixture
def spread(monkeypatch):
    def use():
        monkeypatch.setattr(fitting, "LOCAL_ROWS", 0)
        monkeypatch.setattr(fitting, "BLOCK_ROWS", 128)
    return use


def table(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def close(a, b):
    return np.allclose(np.asarray(a, float), np.asarray(b, float), atol=1e-6)


def test_large_species_go_by_rounds_linear(spark, data, spread):
    spec = L.Linear(l1=3.0, expand="squares")
    here = table(L.fit_linear(data, spec), "species_id")
    spread()
    there = table(L.fit_linear(data, spec), "species_id")
    assert here.keys() == there.keys() and {r["status"] for r in there.values()} == {"ok", "no presences"}
    for k, r in here.items():
        if r["coefficients"] is not None:
            assert close(r["coefficients"], there[k]["coefficients"]) and r["rounds"] == there[k]["rounds"] and there[k]["seconds"] > 0


def test_large_species_go_by_rounds_forest(spark, data, spread):
    spec = trees.Forest(trees=5, part_trees=2, max_features=2, depth=5)
    here = table(trees.fit_forest(data, spec, "features")[1], "species_id", "tree")
    spread()
    there = table(trees.fit_forest(data, spec, "features")[1], "species_id", "tree")
    assert here.keys() == there.keys() and len(here) == 10
    assert all(close(r["nodes"], there[k]["nodes"]) for k, r in here.items())


@pytest.mark.parametrize("options", [{"depth": 2}, {"leaves": 4}])
def test_large_species_go_by_rounds_boosted(spark, data, spread, options):
    spec = trees.Boosted(trees=3, patience=5, **options)
    here = table(trees.fit_boosted(data, spec, "features")[1], "species_id")
    spread()
    there = table(trees.fit_boosted(data, spec, "features")[1], "species_id")
    assert here.keys() == there.keys() == {(1,), (2,)}
    assert all(close(r["nodes"], there[k]["nodes"]) and r["n_trees"] == there[k]["n_trees"] for k, r in here.items())


def test_large_species_go_by_rounds_maxent(spark, data, spread):
    spread()
    rows = data.where("species_id <> 2").withColumn("predictors", F.slice("features", 1, 2))
    log, model = maxent.fit_maxent(rows, maxent.Maxent(classes="lqt", tolerance=1e-2))
    worst = {r["species_id"]: r["worst"] for r in maxent.optimality(rows, model).collect()}
    assert set(worst) == {1} and worst[1] < 2e-2 and {r["status"] for r in log.collect()} == {"ok", "no presences"}


# ---- trees ----


def brute_split(x, y, min_leaf=1):
    """Purity of the best split at any value."""
    best = -np.inf
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1]:
            a, b = y[x[:, j] <= cut], y[x[:, j] > cut]
            if min(len(a), len(b)) >= min_leaf:
                best = max(best, sum((s.sum() ** 2 + (len(s) - s.sum()) ** 2) / len(s) for s in (a, b)))
    return best


def test_every_split_of_a_tree_is_the_best_one(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = (rng.random(300) < 0.2 + 0.05 * x[:, 0] * (x[:, 1] > 5)).astype(int)
    rows = [(1, i, int(b), 1.0, [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    data = spark.createDataFrame(rows, "species_id bigint, location_id bigint, label int, weight double, features array<double>")
    _, model = trees.fit_forest(data, trees.Forest(trees=1, max_features=3, depth=3, min_leaf=5, bins=64, bootstrap=False), "features")
    nodes = np.asarray(model.first()["nodes"]).reshape(-1, 5)

    def check(at, rows):
        f, cut, left, right, value = nodes[at]
        assert abs(value - y[rows].mean()) < 1e-12
        if f >= 0:
            goes = x[rows, int(f)] <= cut
            sides = [y[rows[goes]], y[rows[~goes]]]
            assert abs(sum((s.sum() ** 2 + (len(s) - s.sum()) ** 2) / len(s) for s in sides) - brute_split(x[rows], y[rows], 5)) < 1e-9
            check(int(left), rows[goes]), check(int(right), rows[~goes])

    check(0, np.arange(300))
    assert len(nodes) > 7


def test_bootstrap_is_balanced_and_of_its_own_per_tree():
    n = 4000
    y = np.r_[np.ones(200), np.zeros(n - 200)]
    method = trees.ForestMethod(trees.Forest(trees=30))
    s = method.begin({"p": 2, "part": 0, "param": None, "n": n, "n_pos": 200, "group_id": 1, "edges": np.tile(np.arange(31) / 31, 2)})
    block = fitting.Block(np.arange(n), np.random.default_rng(0).random((n, 2)), y, np.ones(n), np.zeros(n))
    row, node, times, label = method._pairs(s, block)
    per = np.array([[times[(node == t) & (label == c)].sum() for c in (0, 1)] for t in range(30)])
    assert np.abs(per.mean(0) - 200).max() < 12 and len({tuple(p) for p in per}) > 20 and times.max() > 1
    assert abs(len(np.unique(row[label == 0])) - 3800 * (1 - (1 - 200 / 3800 * (1 - np.exp(-1))) ** 30)) < 120  # the background changes from tree to tree


def test_boosting_leaves_are_newton_steps_of_the_best_leaf():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 10, (400, 2)).astype(float)
    y = (rng.random(400) < 0.1 + 0.08 * x[:, 0]).astype(float)
    spec = trees.Boosted(trees=1, leaves=3, subsample=1.0, learning_rate=1.0)
    method = trees.BoostedMethod(spec)
    edges = np.tile(np.arange(10) + 0.0, (2, 1))
    s = method.begin({"p": 2, "part": 0, "param": None, "n": 400, "n_pos": int(y.sum()), "group_id": 1, "edges": edges.ravel()})
    block, done, rounds = fitting.Block(np.arange(400), x, y, np.ones(400), np.zeros(400)), False, 0
    while not done:
        rounds += 1
        s, done = method.solve(s, method.step(s, block), rounds)
    assert rounds == 3  # two splits, and the look after the last tree
    bias, kept, rows = method.tables(s)
    mu = 1 / (1 + np.exp(-bias))
    part = lambda m: ((y - mu)[m].sum()) ** 2 / (mu * (1 - mu) * m.sum() + 1)
    options = [(part(x[:, j] <= c) + part(x[:, j] > c), j, c) for j in (0, 1) for c in range(9)]
    assert kept == 1 and (rows[0, 1], rows[0, 2]) == max(options)[1:] and (rows[:, 1] < 0).sum() == 3
    score = np.log(1 / (1 / trees.boosted_score(bias, rows, x) - 1))
    for value in np.unique(score.round(9)):
        m = np.abs(score - value) < 1e-8
        assert abs(value - bias - (y - mu)[m].sum() / (mu * (1 - mu) * m.sum() + 1)) < 1e-6


# ---- maximum entropy ----


def test_sums_without_columns_equal_those_with():
    rng = np.random.default_rng(3)
    x, r = rng.normal(size=(200, 4)), rng.normal(size=200)
    x[:, 3] = 2.0  # does not vary
    cat = maxent.Catalogue(x.min(0), x.max(0), "lqpth", 7)
    z = cat.columns(x, np.arange(cat.size))
    assert cat.size == 4 + 4 + 6 + 28 + 48
    assert np.allclose(cat.sums(x, r), r @ z) and np.allclose(cat.sums(x, r, True), r @ z**2)
    assert (np.ptp(z, axis=0) <= cat.spread() + 1e-9).all()


def test_maxent_at_full_width_is_optimal(spark):
    rng = np.random.default_rng(4)
    n, p = 1500, 12
    x = rng.normal(size=(n, p))
    y = np.zeros(n, int)
    y[np.argsort(-(2 * x[:, 0] * x[:, 1] - x[:, 2] ** 2 + rng.gumbel(size=n)))[:150]] = 1
    rows = [(1, i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    rows += [(2, i, int(i < 12), [float(v) for v in a]) for i, a in enumerate(x[:300])]
    train = spark.createDataFrame(rows, "species_id bigint, location_id bigint, label int, predictors array<double>")
    log, model = maxent.fit_maxent(train)
    facts = {r["species_id"]: (r["status"], r["classes"]) for r in log.collect()}
    assert facts == {1: ("ok", "lqpht"), 2: ("ok", "lq")}
    held = {r["species_id"]: r for r in maxent.optimality(train, model).collect()}
    assert all(r["worst"] < 2e-3 and abs(r["balance"]) < 2e-3 * r["n_presences"] for r in held.values())
    m = {r["species_id"]: r for r in model.collect()}[1]
    # the cloglog output: shares of the background add up to 1 at alpha, and entropy is theirs
    cat = maxent.Catalogue(np.array(m["lo"]), np.array(m["hi"]), m["classes"])
    share = np.exp(cat.columns(x, np.array(m["feature"])) @ np.array(m["coefficient"]) + m["alpha"])
    assert abs(share.sum() - 1) < 1e-9 and abs(m["entropy"] + (share * np.log(share)).sum()) < 1e-6
    assert 0 < len(m["feature"]) < cat.size / 5


# ---- one layer for all species ----


def test_layer_equals_single_fits(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    seen = [(i, s) for i in range(400) for s in (7, 9, 11) if rng.random() < 1 / (1 + np.exp(1 - s / 9 * x[i, s % 3]))]
    rows = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(x)], "location_id bigint, predictors array<double>")
    spec = layer.Layer("lq", l2=2.0, tolerance=1e-6)
    log, model = layer.fit_layer(rows, spark.createDataFrame(seen, "location_id bigint, species_id bigint"), spec)
    got = {r["species_id"]: r for r in model.collect()}
    z = np.hstack([np.ones((400, 1)), layer.expand(x, "lq")])
    for s in (7, 9, 11):
        y, b, pen = np.array([(i, s) in set(seen) for i in range(400)], float), np.zeros(7), np.diag([0.0] + [2.0] * 6)
        for _ in range(30):
            mu = 1 / (1 + np.exp(-z @ b))
            b -= np.linalg.solve((z * (mu * (1 - mu))[:, None]).T @ z + pen, z.T @ (mu - y) + pen @ b)
        assert np.allclose([got[s]["intercept"], *got[s]["coefficients"]], b, atol=1e-4)
    assert {r["status"] for r in log.collect()} == {"ok"}


def test_layer_features_are_those_of_the_columns(spark):
    from florapark.functions.features import maxent_features

    x = [[0.5, -1.0, 2.9], [0.0, 0.0, -3.5]]
    rows = spark.createDataFrame([(v,) for v in x], "x array<double>")
    want = np.array([r[0] for r in rows.select(maxent_features("x", "lqpth")).collect()])
    assert np.allclose(layer.expand(np.array(x), "lqpth"), want)
    with pytest.raises(ValueError, match="x"):
        layer.expand(np.array(x), "lx")


# ---- tuned fits ----


def test_tuned_fit_takes_the_best_value_of_the_grid(spark, data):
    train = data.where("species_id < 3").withColumnRenamed("features", "predictors").drop("weight")
    rows = train.withColumn("split", F.when(F.col("location_id") % 3 == 0, "val").otherwise("test"))
    grid = (0.001, 0.1, 10.0)
    log, selected, predictions = L.tuned_fit(train, rows, "glm", grid)
    scores = {}
    for c in grid:
        _, _, metrics = L.fit_predict_many(train, rows.where("split = 'val'"), "glm", C=c)
        for r in metrics.collect():
            scores.setdefault(r["species_id"], []).append(r["auroc"])
    best = {s: grid[int(np.argmax(v))] for s, v in scores.items()}
    assert {r["species_id"]: r["param"] for r in selected.collect()} == best
    assert {r["species_id"]: (r["param"], r["status"]) for r in log.collect()} == {s: (v, "ok") for s, v in best.items()}
    for s, c in best.items():
        _, alone, _ = L.fit_predict_many(train.where(F.col("species_id") == s), rows, "glm", C=c)
        a, b = table(alone, "species_id", "location_id"), table(predictions.where(F.col("species_id") == s), "species_id", "location_id")
        assert a.keys() == b.keys() and all(abs(r["probability"] - b[k]["probability"]) < 1e-9 for k, r in a.items())


@pytest.mark.parametrize("name,grid,options", [("randomforest", (1, 3), {"trees": 6}), ("brt", (1, 3), {"trees": 6}), ("gam", (0.1, 100.0), {}), ("maxent", (0.5, 4.0), {"classes": "lq"})])
def test_every_model_can_be_tuned(spark, data, name, grid, options):
    train = data.withColumnRenamed("features", "predictors").drop("weight")
    rows = train.withColumn("split", F.lit("val"))
    log, selected, predictions = L.tuned_fit(train, rows, name, grid, **options)
    facts = {r["species_id"]: r for r in log.collect()}
    chosen = {r["species_id"]: r["param"] for r in selected.collect()}
    assert set(facts) == {1, 2, 3} and facts[3]["status"] == "no presences" and set(chosen) == {1, 2}
    assert all(facts[s]["param"] == chosen[s] and facts[s]["seconds"] > 0 for s in chosen)
    assert predictions.count() == 1500


def test_models_leave_a_task_in_small_frames():
    opened, most = 0, 0

    def rows():
        nonlocal opened
        for i in range(200):
            opened += 1
            yield i, None, np.zeros(1 << 16)  # half a megabyte

    seen = 0
    for frame in fitting._frames(rows(), ["species_id", "param", "nodes"]):
        seen += len(frame)
        assert opened == seen  # nothing is opened ahead of what is passed on
        most = max(most, len(frame))
    assert seen == 200 and most * (1 << 19) <= 2 * fitting.HELD_BYTES
    assert list(fitting._frames(iter([]), ["a"])) == []


@pytest.mark.parametrize("n", [2_000, 400_000])
def test_layer_balances_large_species_as_well_as_small_ones(n):
    """Probabilities add up to the presences to within a twentieth, whatever their number."""
    rng = np.random.default_rng(1)
    x = rng.random((n, 3))
    labels = [np.flatnonzero(rng.random(2) < (0.7 * v[0], 0.2 + 0.3 * v[1] * v[2])) for v in x]
    spec = layer.Layer(codes="lq")
    method = layer.LayerMethod(spec, 2)
    s, done, rounds = method.begin({"part": 0}), False, 0
    block = fitting.Block(np.arange(n), x, np.zeros(n), np.ones(n), np.zeros(n), labels)
    while not done:
        rounds += 1
        s, done = method.solve(s, method.step(s, block), rounds)
    w = method.weights(s)
    p = 1 / (1 + np.exp(-(w[0] + layer.expand(x, "lq") @ w[1:])))
    seen = np.bincount(np.concatenate(labels), minlength=2)
    assert rounds < spec.rounds and np.abs(p.sum(0) - seen).max() < 0.05


def test_small_species_are_neither_described_nor_packed_before_their_task(spark, data, monkeypatch):
    def never(*_):
        raise AssertionError("rows of small species go to their task as they are")

    monkeypatch.setattr(fitting, "pack", never)
    monkeypatch.setattr(fitting, "describe", never)
    table = L.fit_linear(data, L.Linear(l2=1.0))
    held = {r["species_id"]: r for r in L.linear_residuals(data, table, L.Linear(l2=1.0)).collect()}
    assert held and all(r["worst"] < 1e-3 and abs(r["balance"]) < 1e-3 for r in held.values())


def test_quantiles_in_a_task_are_exact():
    x = np.random.default_rng(1).random((30_000, 2))
    found = fitting._described(x, 32)
    want = np.quantile(x, np.arange(1, 32) / 32, axis=0, method="inverted_cdf").T
    assert np.array_equal(found["edges"].reshape(2, -1), want)
    assert np.array_equal(found["lo"], x.min(0)) and np.array_equal(found["hi"], x.max(0))


def test_weights_do_not_shuffle_the_rows(spark, data):
    plan = W.presence_background_weights(data, "glm")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_residuals_of_many_species_are_not_worked_out_in_one_task(spark, data):
    table = L.fit_linear(data, L.Linear(l2=1.0))
    held = L.linear_residuals(data, table, L.Linear(l2=1.0))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert held.rdd.getNumPartitions() == parts > 1


def test_forest_parts_rate_rows_like_their_trees(spark):
    rng = np.random.default_rng(11)
    x = rng.random((300, 3))
    rows = [(1, i, int(b), 1.0, [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, rng.random(300) < x[:, 0]))]
    data = spark.createDataFrame(rows, "species_id bigint, location_id bigint, label int, weight double, features array<double>")
    spec = trees.Forest(trees=5, part_trees=2)
    of = lambda scored: {r["location_id"]: r["probability"] for r in scored.collect()}
    one = of(trees.score_forest(trees.fit_forest(data, spec, "features")[1], data, "features"))
    two = of(trees.score_parts(trees.fit_parts(data, spec, "features")[1], data, "features"))
    assert len(two) == 300 and max(abs(one[k] - two[k]) for k in one) < 1e-12


def test_rows_go_on_from_the_node_where_they_stood():
    rng = np.random.default_rng(4)
    bins, memo = rng.integers(0, 8, (500, 3)).astype(np.int32), {}
    nodes = [[-1, 0, -1, -1, 0.0, 0]]
    for k, f, c in ((0, 1, 3), (2, 0, 5), (1, 2, 2), (4, 1, 6)):
        nodes[k][:4] = f, c, len(nodes), len(nodes) + 1
        nodes += [[-1, 0, -1, -1, 0.0, nodes[k][5] + 1] for _ in range(2)]
        at = trees.BoostedMethod._reached(memo, 7, nodes, bins)
        assert (at == trees.BoostedMethod._reached({}, 7, nodes, bins)).all()
        for row in range(500):
            place = 0
            while nodes[place][0] >= 0:
                f_, c_, left, right = nodes[place][:4]
                place = left if bins[row, f_] <= c_ else right
            assert place == at[row]


def test_fits_of_many_small_groups_get_tasks_of_their_own(spark):
    rows = [(s, i, int(i % 3 == 0), 1.0, [float(i * s % 7), float(i % 5)]) for s in range(1, 41) for i in range(20)]
    data = spark.createDataFrame(rows, "species_id bigint, location_id bigint, label int, weight double, features array<double>")
    final, _ = fitting.fit(data, trees.BoostedMethod(trees.Boosted(trees=1)), 8, "features")
    cores = spark.sparkContext.defaultParallelism
    assert final.select(F.spark_partition_id()).distinct().count() > min(20, cores) and final.where("state is not null").count() == 40
