"""Per-species models for all species in one job.

Linear models are here, forests and boosted trees in ``trees``, maximum entropy in
``maxent``; all are fitted by ``fitting``, in blocks of rows, so that no species is ever
gathered whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from florapark.functions import features as X
from florapark.operators import fitting, maxent, trees
from florapark.operators.experiments import select_hyperparameter
from florapark.operators.metrics import compute_metrics
from florapark.operators.weights import presence_background_weights
from florapark.session import pin

Solve = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, bool]]


# ---- penalised logistic regression ----


@dataclass(frozen=True)
class Linear:
    """How a linear model is fitted.

    ``l2`` and ``l1`` are penalties on the coefficients of standardised features (the
    intercept is free); ``smooth`` is the weight of squared second differences inside
    runs of ``n_splines`` neighbouring coefficients.
    """

    l2: float = 0.0
    l1: float = 0.0
    smooth: float = 0.0
    n_splines: int = 0
    expand: str = ""  # 'squares' adds the squares of the predictors, 'splines' replaces them by B-spline columns over their range
    rounds: int = 25
    tolerance: float = 1e-6


RIDGE_FLOOR = 1e-6
# a fit that ran out of rounds is still scored; its status says so
FITTED = "status not in ('no presences', 'no background')"
LARGEST_STEP = 4.0


def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(y), (y > 0).sum()], x.sum(0), (x * x).sum(0)])


def summary(sums: np.ndarray) -> np.ndarray:
    """n, n_pos, then mean and deviation of each feature; a deviation of 0 counts as 1."""
    n, (s, ss) = sums[0], np.split(sums[2:], 2)
    sd = np.sqrt(np.maximum(ss / n - (s / n) ** 2, 0))
    return np.concatenate([sums[:2], s / n, np.where(sd > 1e-12, sd, 1.0)])


def standardised(state, x):
    """Columns of features less their mean, by their deviation, after one of ones; state: betas, n, n_pos, mean, sd."""
    p = x.shape[1]
    z = np.ones((len(x), p + 1))
    np.divide(x - state[p + 3: 2 * p + 3], state[2 * p + 3:], out=z[:, 1:])
    return z


def newton_step(state, z, y, w):
    """Gradient, curvature and loss of the weighted log-likelihood over standardised features."""
    beta = state[:z.shape[1]]
    mu = 1 / (1 + np.exp(-np.clip(z @ beta, -35, 35)))
    g = z.T @ (w * (mu - y))
    h = (z * (w * np.maximum(mu * (1 - mu), 1e-9))[:, None]).T @ z
    loss = -np.sum(w * np.where(y > 0, np.log(mu), np.log1p(-mu)))
    return np.concatenate([g, h.ravel(), [loss]])


def difference_penalty(p: int, n_splines: int) -> np.ndarray:
    d = np.diff(np.eye(n_splines), n=2, axis=0)
    return np.kron(np.eye(p // n_splines), d.T @ d)


def penalised_solve(spec: Linear) -> Solve:
    """One penalised Newton move: coordinate descent on the quadratic model with soft thresholds."""

    def solve(state, sums, rounds):
        q = int(round((-1 + np.sqrt(1 + 4 * (len(sums) - 1))) / 2))
        p = q - 1
        beta = state[:q].copy()
        g, h = sums[:q], sums[q: q + q * q].reshape(q, q)
        quad = np.zeros((q, q))
        quad[1:, 1:] += spec.l2 * np.eye(p)
        if spec.smooth:
            quad[1:, 1:] += spec.smooth * difference_penalty(p, spec.n_splines)
        lam = np.concatenate([[0.0], np.full(p, spec.l1)])
        a = h + quad + RIDGE_FLOOR * np.eye(q)
        b = a @ beta - (g + quad @ beta)
        if not lam.any():
            new, settled = np.linalg.solve(a, b), True
        else:
            new, settled = beta.copy(), False
            for _ in range(200):
                biggest = 0.0
                for j in range(q):
                    r = b[j] - a[j] @ new + a[j, j] * new[j]
                    v = np.sign(r) * max(abs(r) - lam[j], 0.0) / a[j, j]
                    biggest = max(biggest, abs(v - new[j]))
                    new[j] = v
                if biggest < spec.tolerance / 10:
                    settled = True
                    break
        move = new - beta
        size = np.abs(move).max()
        if size > LARGEST_STEP:
            move *= LARGEST_STEP / size
        state = state.copy()
        state[:q] = beta + move
        return state, bool(settled and size < spec.tolerance)

    return solve


def expansion(spec: Linear, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Feature columns of a linear model; splines are cubic, over evenly spaced knots on the range lo to hi of each predictor."""
    if spec.expand == "squares":
        return np.hstack([x, x * x])
    if spec.expand != "splines":
        return x
    width = np.where(hi > lo, hi - lo, 1.0) / (spec.n_splines - 3)
    at = (np.clip(x, lo, hi) - lo) / width
    missing = np.isnan(at)
    first = np.clip(np.where(missing, 0, at).astype(np.int64), 0, spec.n_splines - 4)  # of the four columns that are not 0
    out = np.zeros((len(x), x.shape[1] * spec.n_splines))
    place = (np.arange(len(x))[:, None] * out.shape[1] + np.arange(x.shape[1]) * spec.n_splines + first).ravel()
    for k in range(4):
        u = np.abs(at - (first + k - 1))
        v = (4 - 6 * (u * u) + 3 * (u * u * u)) / 6 if k in (1, 2) else (2 - u) ** 3 / 6
        out.ravel()[place + k] = np.where(missing, 0.0, v).ravel()
    return out


class LinearMethod(fitting.Method):
    """Moments first, then penalised Newton rounds; ``with_param`` turns a parameter value into settings."""

    def __init__(self, spec: Linear, with_param: Callable[[Linear, float], Linear] | None = None):
        self.spec, self.with_param = spec, with_param

    def begin(self, group):
        param = group["param"]
        own = self.spec if self.with_param is None or param is None or np.isnan(param) else self.with_param(self.spec, float(param))
        return {"spec": own, "lo": np.asarray(group["lo"], float), "hi": np.asarray(group["hi"], float), "array": None, "converged": False}

    def step(self, s, block):
        # neither depends on the penalty, so all units of a group share them
        if s["array"] is None:
            if "z" not in block.shared:
                block.shared["z"] = expansion(s["spec"], s["lo"], s["hi"], block.x)
            return moments(block.shared["z"], block.y)
        if "standardised" not in block.shared:
            z = block.shared.get("z")
            block.shared["standardised"] = standardised(s["array"], expansion(s["spec"], s["lo"], s["hi"], block.x) if z is None else z)
        return newton_step(s["array"], block.shared["standardised"], block.y, block.w)

    def solve(self, s, sums, rounds):
        if s["array"] is None:
            stats = summary(sums)
            return s | {"array": np.concatenate([np.zeros((len(stats) - 2) // 2 + 1), stats])}, False
        array, settled = penalised_solve(s["spec"])(s["array"], sums, rounds)
        return s | {"array": array, "converged": settled}, settled or rounds > s["spec"].rounds


def linear_table(s) -> list[tuple]:
    """Intercept and coefficients on the features as they are."""
    a = s["array"]
    p = (len(a) - 3) // 3
    beta, mean, sd = a[:p + 1], a[p + 3:2 * p + 3], a[2 * p + 3:]
    slope = beta[1:] / sd
    return [(float(beta[0] - slope @ mean), slope, s["lo"], s["hi"], bool(s["converged"]))]


def fit_linear(train: DataFrame, spec: Linear, features: str = "features", params: DataFrame | None = None, grid: Sequence[float] = (),
               with_param: Callable[[Linear, float], Linear] | None = None) -> DataFrame:
    """One row per species (and parameter value): intercept, coefficients on the expanded features, ranges, and the log of the fit."""
    final, described = fitting.fit(train, LinearMethod(spec, with_param), 0, features, params=params, grid=grid)
    final = pin(final)
    model = fitting.models(final, linear_table, "intercept double, coefficients array<double>, lo array<double>, hi array<double>, converged boolean")
    log = fitting.fit_log(final, described)
    both = log.alias("l").join(model.alias("m"), F.expr("l.species_id = m.species_id and l.param <=> m.param"), "left")
    status = F.when(~F.col("converged"), "not converged").otherwise(F.col("status"))
    return both.select("l.*", "intercept", "coefficients", "lo", "hi", "converged").withColumns(
        {"status": status, "n_features": F.coalesce(F.size("coefficients"), F.lit(0)) if spec.expand else F.col("n_features")}).drop("converged")


def linear_residuals(train: DataFrame, table: DataFrame, spec: Linear, features: str = "features") -> DataFrame:
    """(species_id, balance, worst) of fitted models, worked out anew from the rows (species_id, label, weight, features).

    ``balance`` is the weighted sum of probability less label; ``worst`` the largest miss of
    an optimality condition over the standardised features. Only aggregates cross species.
    """
    schema = "species_id bigint, j int, k double, r double, f double, f2 double, rf double, beta double, intercept double"

    def each(block: fitting.Block, m: dict) -> Iterator[pd.DataFrame]:
        z = expansion(spec, np.asarray(m["lo"]), np.asarray(m["hi"]), block.x)
        slope = np.asarray(m["coefficients"], float)
        r = block.w * (1 / (1 + np.exp(-np.clip(m["intercept"] + z @ slope, -35, 35))) - block.y)
        yield pd.DataFrame({"species_id": m["group_id"], "j": np.arange(z.shape[1], dtype=np.int32), "k": float(len(z)), "r": r.sum(), "f": z.sum(0),
                            "f2": (z * z).sum(0), "rf": r @ z, "beta": slope, "intercept": m["intercept"]})

    def worst(rows: pa.Table) -> pa.Table:
        # one row per feature of a species
        d = {c: rows.column(c).to_numpy() for c in rows.column_names}
        d = {c: v[np.argsort(d["j"])] for c, v in d.items()}
        mean = d["f"] / d["k"]
        sd = np.sqrt(np.maximum(d["f2"] / d["k"] - mean**2, 0))
        sd = np.where(sd > 1e-12, sd, 1.0)
        beta, g = d["beta"] * sd, (d["rf"] - mean * d["r"]) / sd
        g = g + spec.l2 * beta
        if spec.smooth:
            g = g + spec.smooth * difference_penalty(len(beta), spec.n_splines) @ beta
        miss = np.where(beta != 0, np.abs(g + spec.l1 * np.sign(beta)), np.maximum(np.abs(g) - spec.l1, 0))
        return pa.table({"species_id": d["species_id"][:1], "balance": d["r"][:1], "worst": [float(miss.max())]})

    met = fitting.over_rows(train, table.where(FITTED).select("species_id", "intercept", "coefficients", "lo", "hi"), each, schema, features)
    sums = ("k", "r", "f", "f2", "rf")
    summed = met.groupBy("species_id", "j", "beta", "intercept").agg(*[F.sum(c).alias(c) for c in sums])
    # few bytes but work for every species: a stated number of parts, which adaptive execution does not merge into one task
    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return summed.repartition(parts, "species_id").groupBy("species_id").applyInArrow(worst, "species_id bigint, balance double, worst double")


# ---- choosing, scoring, evaluating ----


def score_linear(model: DataFrame, rows: DataFrame, features: str = "features", link: str = "logit") -> DataFrame:
    """Probability of every (species, row) pair; ``rows`` has species_id, or gets every species of the model.

    Plain column expressions: dot product with the coefficients, then the link.
    """
    cols = ["species_id", "intercept", "coefficients"] + [c for c in ("alpha", "entropy") if c in model.columns]
    keep = [c for c in rows.columns if c != features]
    joined = rows.join(model.where(FITTED).select(*cols), "species_id")
    eta = X.dot(features, "coefficients")
    if link == "logit":
        prob = X.sigmoid(F.col("intercept") + eta)
    elif link == "cloglog":
        prob = 1 - F.exp(-F.exp(eta + F.col("alpha") + F.col("entropy")))
    else:
        raise ValueError("link must be 'logit' or 'cloglog'")
    return joined.select(*keep, prob.alias("probability"))


def as_scorer(predict: Callable[[np.ndarray], np.ndarray], features: str = "features"):
    """Turn a caller's batch function (matrix to vector) into a scorer of a table."""

    def score(rows: DataFrame) -> DataFrame:
        keep = [c for c in rows.columns if c != features]
        schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", probability double"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                prob = np.asarray(predict(np.vstack(b[features].to_list())), dtype=float) if len(b) else np.empty(0)
                yield b[keep].assign(probability=prob)

        return rows.mapInPandas(run, schema)

    return score


def frozen_parameters(species: DataFrame, selected: DataFrame, default: float, integer: bool = False) -> DataFrame:
    """Per species the selected value, else the default; whole numbers for forests and boosted trees."""
    value = F.coalesce(F.col("param").cast("double"), F.lit(float(default)))
    return species.select("species_id").join(selected.select("species_id", "param"), "species_id", "left").select(
        "species_id", (value.cast("int") if integer else value).alias("param"))


@dataclass(frozen=True)
class Model:
    """A named model: ``fit(train, params, grid)`` gives (log, table), ``score(table, rows, by)`` rates (species, row) pairs.

    Both read the column ``predictors``. ``param`` names what a parameter value sets,
    ``default`` is its value where none is chosen, ``whole`` says whether it is a whole number.
    """

    fit: Callable[..., tuple[DataFrame, DataFrame]]
    score: Callable[..., DataFrame]
    param: str
    default: float
    whole: bool = False


def _linear(spec: Linear, param: str, default: float, with_param: Callable[[Linear, float], Linear]) -> Model:
    def fit(train: DataFrame, params: DataFrame | None = None, grid: Sequence[float] = ()) -> tuple[DataFrame, DataFrame]:
        table = pin(fit_linear(train, spec, "predictors", params, grid, with_param))
        return table.drop("intercept", "coefficients", "lo", "hi"), table.where(FITTED)

    def predict(fields: dict, x: np.ndarray) -> np.ndarray:
        array = lambda c: fields[c].values.to_numpy(zero_copy_only=False)
        eta = fields["intercept"].as_py() + expansion(spec, array("lo"), array("hi"), x) @ array("coefficients")
        return 1 / (1 + np.exp(-np.clip(eta, -700, 700)))

    return Model(fit, lambda m, r, by=(): fitting.score(m.drop("status"), r, predict, by=by), param, default)


def _maxent(spec: maxent.Maxent) -> Model:
    return Model(lambda t, params=None, grid=(): maxent.fit_maxent(t, spec, params=params, grid=grid),
                 lambda m, r, by=(): fitting.score(m, r, maxent.predict, by=by), "strength", 1.0)


def _boosted(spec: trees.Boosted, param: str = "leaves") -> Model:
    return Model(lambda t, params=None, grid=(): trees.fit_boosted(t, spec, params=params, grid=grid),
                 lambda m, r, by=(): trees.score_boosted(m, r, by=by), param, max(spec.leaves - 1, 1), True)


def _forest(spec: trees.Forest) -> Model:
    return Model(lambda t, params=None, grid=(): trees.fit_parts(t, spec, params=params, grid=grid),
                 lambda m, r, by=(): trees.score_parts(m, r, by=by), "max_features", spec.max_features, True)


def get_model(name: str, **options) -> Model:
    """The model registry; ``options`` override its defaults."""
    strength = options.get("C", 1.0)
    registry: dict[str, Callable[[], Model]] = {
        "logistic": lambda: _linear(Linear(l2=1.0 / strength), "C", strength, lambda s, v: replace(s, l2=1.0 / v)),
        "glm": lambda: _linear(Linear(l1=1.0 / strength, expand="squares"), "C", strength, lambda s, v: replace(s, l1=1.0 / v)),
        "gam": lambda: _linear(
            Linear(smooth=options.get("lam", 0.6), l2=1e-3, n_splines=options.get("n_splines", 10), expand="splines"),
            "lam", options.get("lam", 0.6), lambda s, v: replace(s, smooth=v)),
        "maxent": lambda: _maxent(maxent.Maxent(**_known(maxent.Maxent, options))),
        "brt": lambda: _boosted(trees.Boosted(**{"leaves": options.get("tc", 3) + 1, "patience": 20, **_known(trees.Boosted, options)}), "tc"),
        "gradientboosting": lambda: _boosted(trees.Boosted(**_known(trees.Boosted, options))),
        "lightgbm": lambda: _boosted(trees.Boosted(**{"leaves": 31, "subsample": 1.0, **_known(trees.Boosted, options)})),
        "xgboost": lambda: _boosted(trees.Boosted(**{"depth": 6, "subsample": 1.0, **_known(trees.Boosted, options)})),
        "randomforest": lambda: _forest(trees.Forest(**_known(trees.Forest, options))),
    }
    if name not in registry:
        raise ValueError(f"unknown model {name!r}; available: {sorted(registry)}")
    return registry[name]()


def _known(cls, options: dict) -> dict:
    return {k: v for k, v in options.items() if k in cls.__dataclass_fields__}


def fit_predict_many(
    train: DataFrame, evaluation: DataFrame, model_name: str, predictors: str = "predictors", params: DataFrame | None = None, **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit every species, score its evaluation rows, and rate each split.

    ``train``: species_id, location_id, label, predictors, or ``sampling.training_table``. ``evaluation``: species_id,
    location_id, split, label (null = ignored), predictors. ``params`` (species_id, param)
    gives species a parameter value of their own. Returns (log of the fits, predictions,
    metrics by split and species). A species that cannot be fitted keeps a row in the log
    with its status and gets no predictions.
    """
    model = get_model(model_name, **options)
    # counted, then fitted; packed rows know their number and are opened anew instead of written
    train = train.withColumnRenamed(predictors, "predictors")
    weighted = presence_background_weights(train if fitting.is_packed(train) else pin(train), model_name)
    log, table = model.fit(weighted, params)
    predictions = model.score(pin(table), evaluation.withColumnRenamed(predictors, "predictors"))
    metrics = compute_metrics(predictions, ("auroc", "auprg"), keys=("split", "species_id"))
    return log, predictions, metrics


def tuned_fit(
    train: DataFrame, evaluation: DataFrame, model_name: str, grid: Sequence[float], metric: str = "auroc", split: str = "val", **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Choose a parameter value per species and fit again with it: (log, selected, predictions).

    All values of ``grid`` are fitted in one pass over the rows of a species and rated on
    the rows of ``split``. The value with the best score is chosen (the first of equals); a
    species without a defined score gets the model's default. ``log`` is that of the last
    fit, with the value used; ``selected`` has species_id, param and score.
    """
    model = get_model(model_name, **options)
    weighted = presence_background_weights(train, model_name)
    weighted = weighted if fitting.is_packed(train) else pin(weighted)
    _, tables = model.fit(weighted, None, grid)
    rated = model.score(pin(tables), evaluation.where(F.col("split") == split), ("param",))
    scores = compute_metrics(rated, (metric,), keys=("param", "species_id"))
    selected = pin(select_hyperparameter(scores.select("species_id", "param", F.col(metric).alias("value")), grid))
    species = weighted.select("species_id").distinct()
    frozen = pin(frozen_parameters(species, selected, model.default, model.whole))
    log, table = model.fit(weighted, frozen)
    return log, selected, model.score(pin(table), evaluation)
