"""Maximum entropy models of presences against background, at the full width of feature classes.

Features of p predictors: l as is, q squares, p products of pairs, t steps, h hinges in both
directions; a species gets the classes its number of presences allows. There can be
thousands, nearly all with a coefficient of 0. A round therefore asks for the gradient of
*all* features, which needs no feature column (sums over sorted bins give it for steps and
hinges, one matrix product for pairs), and for the curvature of the *working set* alone.
Features that break optimality join the set; the penalty falls to its final weight by
halves, each fit starting from the one before. A fit is done when the conditions of
optimality hold for every feature, in the set or not.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from florapark.functions.features import LEVELS
from florapark.operators import fitting
from florapark.operators.fitting import Method
from florapark.session import pin, ship

# fixed values: published penalty tables of the feature classes (presences, multiplier)
TABLES = {
    "l": ((0, 10, 30, 100), (1.0, 1.0, 0.2, 0.05)),
    "q": ((0, 10, 17, 30, 100), (1.3, 0.8, 0.5, 0.25, 0.05)),
    "p": ((0, 10, 17, 30, 100), (2.6, 1.6, 0.9, 0.55, 0.05)),
    "t": ((0, 100), (2.0, 1.0)),
    "h": ((0, 1), (0.5, 0.5)),
}
BACKGROUND_WEIGHT = 100.0  # fixed value: weight of a background row against a presence
_ROWS = 4096  # rows whose active features are held at once


class Catalogue:
    """The features of one species: predictors' ranges and the letters of the classes, in the order l, q, p, t, h."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, classes: str, knots: int = LEVELS):
        self.lo, self.hi, self.classes = np.asarray(lo, float), np.asarray(hi, float), classes
        p, span = len(self.lo), np.asarray(hi, float) - lo
        self.cuts = self.lo[:, None] + span[:, None] * np.arange(1, knots + 1) / (knots + 1)
        self.knots = self.lo[:, None] + span[:, None] * np.arange(knots) / (knots - 1)
        with np.errstate(divide="ignore"):
            # a predictor that does not vary has no hinges
            self.up, self.down = 1 / (self.hi[:, None] - self.knots[:, :-1]), 1 / (self.knots[:, 1:] - self.lo[:, None])
        self.up[~np.isfinite(self.up)], self.down[~np.isfinite(self.down)] = 0, 0
        self.pairs = np.triu_indices(p, 1)
        sizes = {"l": p, "q": p, "p": len(self.pairs[0]), "t": p * knots, "h": 2 * p * (knots - 1)}
        self.parts, at = {}, 0
        for c in "lqpth":
            if c in classes:
                self.parts[c] = slice(at, at + sizes[c])
                at += sizes[c]
        self.size = at

    def spread(self) -> np.ndarray:
        """Width of the range of each feature, from the ranges of the predictors."""
        out = np.zeros(self.size)
        corner = lambda a, b: np.stack([self.lo[a] * self.lo[b], self.lo[a] * self.hi[b], self.hi[a] * self.lo[b], self.hi[a] * self.hi[b]])
        every = np.arange(len(self.lo))
        values = {"l": lambda: self.hi - self.lo, "q": lambda: np.ptp(corner(every, every), axis=0), "p": lambda: np.ptp(corner(*self.pairs), axis=0),
                  "t": lambda: np.repeat(self.hi > self.lo, self.cuts.shape[1]), "h": lambda: np.concatenate([(self.up > 0).ravel(), (self.down > 0).ravel()])}
        for c, at in self.parts.items():
            out[at] = values[c]()
        return out

    def sums(self, x: np.ndarray, r: np.ndarray, squares: bool = False) -> np.ndarray:
        """Sum over rows of r times each feature (or its square), without feature columns."""
        out, power = np.zeros(self.size), 2 if squares else 1
        if "l" in self.parts:
            out[self.parts["l"]] = r @ x**power
        if "q" in self.parts:
            out[self.parts["q"]] = r @ x ** (2 * power)
        if "p" in self.parts:
            y = x**power
            out[self.parts["p"]] = (y.T @ (r[:, None] * y))[self.pairs]
        if "t" in self.parts:
            above = [np.bincount(np.searchsorted(c, v, "left"), r, len(c) + 1)[::-1].cumsum()[::-1][1:] for c, v in zip(self.cuts, x.T)]
            out[self.parts["t"]] = np.concatenate(above)
        if "h" in self.parts:
            up, down = np.zeros_like(self.up), np.zeros_like(self.down)
            for j, (k, v) in enumerate(zip(self.knots, x.T)):
                # bin i holds the values over i knots
                bins = np.searchsorted(k, v, "left")
                m = [np.bincount(bins, r * v**e, len(k) + 1) for e in range(power + 1)]
                over = [s[::-1].cumsum()[::-1][1:-1] for s in m]
                under = [s.cumsum()[1:-1] for s in m]
                a, b = k[:-1], k[1:]
                if squares:
                    up[j], down[j] = over[2] - 2 * a * over[1] + a * a * over[0], b * b * under[0] - 2 * b * under[1] + under[2]
                else:
                    up[j], down[j] = over[1] - a * over[0], b * under[0] - under[1]
            out[self.parts["h"]] = np.concatenate([(up * self.up**power).ravel(), (down * self.down**power).ravel()])
        return out

    def columns(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The features numbered ``which``, one column each."""
        out = np.zeros((len(x), len(which)))
        for c, at in self.parts.items():
            here = np.flatnonzero((which >= at.start) & (which < at.stop))
            i = which[here] - at.start
            if not len(here):
                continue
            if c == "l":
                out[:, here] = x[:, i]
            elif c == "q":
                out[:, here] = x[:, i] ** 2
            elif c == "p":
                out[:, here] = x[:, self.pairs[0][i]] * x[:, self.pairs[1][i]]
            elif c == "t":
                j, m = np.divmod(i, self.cuts.shape[1])
                out[:, here] = x[:, j] > self.cuts[j, m]
            else:
                side, rest = np.divmod(i, self.up.size)
                j, m = np.divmod(rest, self.up.shape[1])
                value = np.where(side == 0, (x[:, j] - self.knots[j, m]) * self.up[j, m], (self.knots[j, m + 1] - x[:, j]) * self.down[j, m])
                out[:, here] = np.maximum(value, 0)
        return out


@dataclass(frozen=True)
class Maxent:
    """``classes`` None chooses them by the number of presences; ``strength`` scales all penalties."""

    classes: str | None = None
    strength: float = 1.0
    tolerance: float = 1e-3  # share of its penalty by which a feature may miss optimality
    rounds: int = 400
    joins: int = 100  # features that join the working set in one round at most


def classes_of(n_presences: int) -> str:
    return "l" if n_presences < 10 else "lq" if n_presences < 15 else "lqp" if n_presences < 100 else "lqpht"


class MaxentMethod(Method):
    """Rounds: feature moments over presences; then loss, gradient and curvature; last the normaliser."""

    def __init__(self, spec: Maxent):
        self.spec = spec

    def begin(self, group):
        classes = self.spec.classes or classes_of(int(group["n_pos"]))
        n, k = int(group["n"]), int(group["n_pos"])
        param = group["param"]
        return {"lo": np.asarray(group["lo"], float), "hi": np.asarray(group["hi"], float), "classes": classes, "n_pos": k, "stage": "moments",
                "strength": self.spec.strength if param is None or np.isnan(param) else float(param),
                "set": np.zeros(0, int), "beta": np.array([np.log(k / (BACKGROUND_WEIGHT * n))]), "scale": None, "last": None}

    @staticmethod
    def _catalogue(s) -> Catalogue:
        return Catalogue(s["lo"], s["hi"], s["classes"])

    def step(self, s, block):
        cat, pos = self._catalogue(s), (block.y > 0).astype(float)
        if s["stage"] == "moments":
            return np.concatenate([cat.sums(block.x, pos), cat.sums(block.x, pos, True)])
        a = len(s["set"])
        eta, h, columns = np.empty(len(pos)), np.zeros((a + 1, a + 1)), []
        for low in range(0, len(pos), _ROWS):
            at = slice(low, low + _ROWS)
            z = np.hstack([np.ones((len(pos[at]), 1)), cat.columns(block.x[at], s["set"])])
            eta[at] = z @ s["beta"]
            if s["stage"] == "fit":
                mu = 1 / (1 + np.exp(-np.clip(eta[at], -35, 35)))
                h += (z * ((BACKGROUND_WEIGHT + pos[at]) * np.maximum(mu * (1 - mu), 1e-12))[:, None]).T @ z
        if s["stage"] == "scale":
            e = np.exp(np.minimum(eta, 700))
            return np.array([e.sum(), (e * (eta - s["beta"][0])).sum()])
        mu = 1 / (1 + np.exp(-np.clip(eta, -35, 35)))
        r = BACKGROUND_WEIGHT * mu + pos * (mu - 1)
        loss = -(pos * np.log(mu) + BACKGROUND_WEIGHT * np.log1p(-mu)).sum()
        return np.concatenate([[loss, r.sum()], cat.sums(block.x, r), h.ravel()])

    def solve(self, s, sums, rounds):
        s = dict(s)
        if s["stage"] == "moments":
            s["penalty"] = penalties(self._catalogue(s), s["n_pos"], *np.split(sums, 2)) * s["strength"]
            s["stage"] = "fit"
            return s, False
        if s["stage"] == "scale":
            s["log_z"] = float(np.log(sums[0]) - s["beta"][0])
            s["mean"], s["stage"] = float(sums[1] / sums[0]), "done"
            return s, True
        q, a = len(s["penalty"]), len(s["set"])
        loss, g, h = sums[0], sums[1:2 + q], sums[2 + q:].reshape(a + 1, a + 1)
        lam, beta, chosen = s["penalty"], s["beta"], s["set"]
        if s["scale"] is None:  # where the first feature would get a coefficient
            s["scale"] = max(1.0, float(np.max(np.abs(g[1:]) / lam)) / 2)
        weight = s["scale"] * lam
        size = loss + (weight[chosen] * np.abs(beta[1:])).sum()
        if s["last"] is not None and size > s["last"]["size"] + 1e-10 * abs(s["last"]["size"]) and s["last"]["share"] > 1e-6:
            # the step went too far
            s["last"] = last = s["last"] | {"share": s["last"]["share"] / 2}
            s["beta"] = last["beta"] + last["share"] * last["move"]
            return s, False
        miss = np.maximum(np.abs(g[1:]) - weight, 0)
        held = beta[1:] != 0
        miss[chosen[held]] = np.abs(g[1:][chosen[held]] + weight[chosen[held]] * np.sign(beta[1:][held]))
        worst = max(float((miss / weight).max()), abs(g[0]) / s["n_pos"])
        s["worst"] = worst
        # on the way down a rough fit will do
        if worst <= (self.spec.tolerance if s["scale"] == 1 else 0.1) or rounds >= self.spec.rounds:
            if s["scale"] == 1 or rounds >= self.spec.rounds:
                s["stage"], s["converged"] = "scale", worst <= self.spec.tolerance
                keep = np.flatnonzero(held)
                s["set"], s["beta"] = chosen[keep], np.r_[beta[0], beta[1:][keep]]
                return s, False
            s["scale"] = max(1.0, s["scale"] / 2)
            weight = s["scale"] * lam
            size = loss + (weight[chosen] * np.abs(beta[1:])).sum()
            miss = np.maximum(np.abs(g[1:]) - weight, 0)
        move = newton(beta, g[np.r_[0, chosen + 1]], h, np.r_[0.0, weight[chosen]])
        joining = np.flatnonzero(miss > 0)
        joining = joining[~np.isin(joining, chosen)]
        joining = joining[np.argsort(-(miss / weight)[joining], kind="stable")][:self.spec.joins]
        # features that fell back to 0 leave when others join
        stay = np.flatnonzero((beta[1:] + move[1:] != 0) | (beta[1:] != 0)) if len(joining) else np.arange(a)
        pad = np.zeros(len(joining))
        beta, move = np.r_[beta[0], beta[1:][stay], pad], np.r_[move[0], move[1:][stay], pad]
        s["set"], s["last"] = np.r_[chosen[stay], joining], {"size": size, "beta": beta, "move": move, "share": 1.0}
        s["beta"] = beta + move
        return s, False


def penalties(cat: Catalogue, k: int, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Penalty of each feature's absolute coefficient, from its sums over the ``k`` presences; endless where a feature does not vary."""
    spread = cat.spread()
    sd = np.sqrt(np.maximum(squares - total**2 / k, 0) / max(k - 1, 1))
    floor = 0.001 * spread
    out = np.zeros(cat.size)
    for c, at in cat.parts.items():
        out[at] = sd[at] * np.interp(k, *TABLES[c]) / np.sqrt(k)
    if "h" in cat.parts:
        at = cat.parts["h"]
        floor[at] = np.maximum(floor[at], np.maximum(sd[at], 1 / np.sqrt(k)) * 0.5 / np.sqrt(k))
    if "t" in cat.parts:
        at = cat.parts["t"]
        floor[at] = np.where((total[at] == 0) | (total[at] == k), 1.0, floor[at])
    return np.where(spread > 0, k * np.maximum(out, floor), np.inf)


def newton(beta: np.ndarray, g: np.ndarray, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Move that minimises the quadratic model with absolute penalties.

    Sweeps of coordinate descent find which coefficients are 0 and the signs of the others;
    between them the model is solved for the signs as they are, as far as they last.
    """
    h = h + 1e-9 * np.trace(h) / len(h) * np.eye(len(h))
    new, slope, diagonal = beta.copy(), g.copy(), np.diag(h).copy()
    for _ in range(60):
        for _ in range(3):
            for j in range(len(new)):
                b = new[j] - slope[j] / diagonal[j]
                v = np.sign(b) * max(abs(b) - weight[j] / diagonal[j], 0.0)
                if v != new[j]:
                    slope += h[:, j] * (v - new[j])
                    new[j] = v
        free = np.flatnonzero((new != 0) | (weight == 0))
        sign = np.sign(new[free])
        step = -np.linalg.solve(h[np.ix_(free, free)], slope[free] + weight[free] * sign)
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where((weight[free] > 0) & (sign * (new[free] + step) < 0), -new[free] / step, 1.0)
        share = reach.min()
        moved = new[free] + share * step
        moved[(reach == share) & (share < 1)] = 0.0
        new[free] = moved
        slope = g + h @ (new - beta)
        miss = np.where(new != 0, np.abs(slope + weight * np.sign(new)), np.maximum(np.abs(slope) - weight, 0))
        if (miss / np.maximum(weight, 1e-3 * diagonal)).max() < 1e-4:
            break
    return new - beta


MODEL = ("classes string, lo array<double>, hi array<double>, feature array<int>, coefficient array<double>, "
         "intercept double, alpha double, entropy double, worst double, converged boolean")


def _table(s) -> list[tuple]:
    return [(s["classes"], s["lo"], s["hi"], s["set"].astype(np.int32), s["beta"][1:], s["beta"][0], -s["log_z"], s["log_z"] - s["mean"],
             s["worst"], bool(s["converged"]))]


def fit_maxent(train: DataFrame, spec: Maxent = Maxent(), predictors: str = "predictors", params: DataFrame | None = None,
               grid: Sequence[float] = ()) -> tuple[DataFrame, DataFrame]:
    """(log, model) of all species; a parameter value is the strength of the penalty.

    ``model`` lists the features with a coefficient; ``worst`` is the largest miss of an
    optimality condition, as a share of the penalty.
    """
    final, described = fitting.fit(train, MaxentMethod(spec), 0, predictors, params=params, grid=grid)
    final = pin(final)
    model = pin(fitting.models(final, _table, MODEL))
    facts = model.select("species_id", "param", "classes", "converged")
    log = fitting.fit_log(final, described).alias("l").join(
        facts.alias("m"), F.expr("l.species_id = m.species_id and l.param <=> m.param"), "left")
    status = F.when(~F.col("converged"), "not converged").otherwise(F.col("status"))
    return log.select("l.*", "classes", "converged").withColumn("status", status).drop("converged"), model


def predict(fields: dict, x: np.ndarray) -> np.ndarray:
    """Complementary log-log output of one species for rows ``x``."""
    array = lambda c: fields[c].values.to_numpy(zero_copy_only=False)
    cat = Catalogue(array("lo"), array("hi"), fields["classes"].as_py())
    eta = cat.columns(x, array("feature")) @ array("coefficient")
    return 1 - np.exp(-np.exp(np.minimum(eta + fields["alpha"].as_py() + fields["entropy"].as_py(), 700)))


def optimality(train: DataFrame, model: DataFrame, predictors: str = "predictors", spec: Maxent = Maxent()) -> DataFrame:
    """(species_id, n_presences, classes, balance, worst) worked out anew from the rows, with every feature as a column.

    ``balance`` is the expected less the observed number of presences, ``worst`` the
    largest miss of an optimality condition over all features, as a share of its penalty.
    """
    features = "species_id bigint, feature int, k double, f double, f2 double, r double, rr double"

    def gradient(block: fitting.Block, m: dict) -> Iterator[pd.DataFrame]:
        cat = Catalogue(np.asarray(m["lo"]), np.asarray(m["hi"]), m["classes"])
        pos = (block.y > 0).astype(float)
        eta = m["intercept"] + cat.columns(block.x, np.asarray(m["feature"], int)) @ np.asarray(m["coefficient"], float)
        mu = 1 / (1 + np.exp(-eta))
        r = BACKGROUND_WEIGHT * mu + pos * (mu - 1)
        for low in range(0, cat.size, 512):
            which = np.arange(low, min(low + 512, cat.size), dtype=np.int32)
            z = cat.columns(block.x, which)
            yield pd.DataFrame({"species_id": m["group_id"], "feature": which, "k": pos.sum(), "f": pos @ z, "f2": pos @ z**2, "r": r @ z, "rr": r.sum()})

    def worst(rows: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        # one row per feature of a species
        rows, m = rows.sort_values("feature"), fitted.iloc[0]
        cat = Catalogue(m["lo"], m["hi"], m["classes"])
        k = int(rows["k"].iloc[0])
        lam = penalties(cat, k, rows["f"].to_numpy(), rows["f2"].to_numpy()) * spec.strength
        beta = np.zeros(cat.size)
        beta[np.asarray(m["feature"], int)] = m["coefficient"]
        g = rows["r"].to_numpy()
        miss = np.where(beta != 0, np.abs(g + np.where(beta != 0, lam, 0) * np.sign(beta)), np.maximum(np.abs(g) - lam, 0))
        return pd.DataFrame({"species_id": [m["species_id"]], "n_presences": [k], "classes": [m["classes"]],
                             "balance": [float(rows["rr"].iloc[0])], "worst": [float((miss / lam).max())]})

    met = fitting.over_rows(train, model.drop("alpha", "entropy", "param"), gradient, features, predictors)
    summed = met.groupBy("species_id", "feature").agg(*[F.sum(c).alias(c) for c in ("k", "f", "f2", "r", "rr")])
    return summed.groupBy("species_id").cogroup(model.groupBy("species_id")).applyInPandas(
        worst, "species_id bigint, n_presences bigint, classes string, balance double, worst double")
