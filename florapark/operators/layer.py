"""One linear layer over expanded predictors for all species at once.

Every location is stored once, with the species seen there; features are worked out from
the predictors inside the tasks. Species are fitted in slices: a block gives the gradient
of a whole slice at once. All species of a slice move together by L-BFGS with a step length
of their own; a ridge keeps the overlapping steps and hinges apart. Columns of one predictor
are alike, so moves are first turned by the curvature among them, which is the same for all species but for a factor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from florapark.functions.features import CODES, LEVELS, SPAN
from florapark.operators import fitting
from florapark.operators.fitting import Method
from florapark.session import pin

SLICE = 128  # species fitted together
_ROWS = 1024  # rows whose features are held at once


@dataclass(frozen=True)
class Layer:
    """``codes`` are the feature classes (l as is, q squares, p product of all, t steps, h hinges)."""

    codes: str = "lqpth"
    l2: float = 1.0
    rounds: int = 300
    tolerance: float = 1e-3  # gradient at the end, as a share of the square root of the number of presences
    balance: float = 0.02  # most that the probabilities of a species may add up to beside its presences, however many they are
    history: int = 10
    plain: int = 15  # rounds before moves are turned; small fits end without


def expand(x: np.ndarray, codes: str, n_levels: int = LEVELS) -> np.ndarray:
    """Feature columns in the order l, q, p, t, h, as ``features.maxent_features`` has them."""
    wrong = [c for c in codes if c not in CODES]
    if wrong:
        raise ValueError(f"unknown feature codes {wrong}; allowed: {', '.join(CODES)}")
    levels = np.linspace(*SPAN, n_levels)
    parts = {"l": lambda: x, "q": lambda: x * x, "p": lambda: x.prod(1, keepdims=True), "t": lambda: (x[:, :, None] > levels).reshape(len(x), -1).astype(float),
             "h": lambda: np.maximum(x[:, :, None] - levels, 0).reshape(len(x), -1)}
    chosen = [parts[c]() for c in "lqpth" if c in codes]
    return np.hstack(chosen) if chosen else x


class Levels:
    """Products with a column of ones and ``expand``'s columns, without the columns.

    A step or hinge follows from how many levels lie under a value: its weights are running sums of the levels' weights,
    and sums over its rows are running sums of sums per level. So a value costs a look-up instead of two columns per level.
    """

    def __init__(self, x: np.ndarray, codes: str, n_levels: int = LEVELS):
        self.x, self.codes, self.levels = x, codes, np.linspace(*SPAN, n_levels)
        self.under = np.searchsorted(self.levels, x, side="left")  # levels under each value

    def _parts(self, rows: int) -> dict[str, slice]:
        """Rows of a weight matrix that belong to each class; the first is the intercept's."""
        p, found, at = self.x.shape[1], {}, 1
        sizes = {"l": p, "q": p, "p": 1, "t": p * len(self.levels), "h": p * len(self.levels)}
        for c in [c for c in "lqpth" if c in self.codes] or ["l"]:
            found[c] = slice(at, at + sizes[c])
            at += sizes[c]
        if at != rows:
            raise ValueError(f"{rows} weights for {at} columns")
        return found

    def times(self, weights: np.ndarray) -> np.ndarray:
        """(rows, species): the columns by ``weights`` (columns, species)."""
        parts, (n, p), k = self._parts(len(weights)), self.x.shape, weights.shape[1]
        out = np.repeat(weights[:1], n, axis=0)
        if "l" in parts:
            out += self.x @ weights[parts["l"]]
        if "q" in parts:
            out += (self.x * self.x) @ weights[parts["q"]]
        if "p" in parts:
            out += self.x.prod(1, keepdims=True) @ weights[parts["p"]]
        upto = lambda w: np.concatenate([np.zeros((p, 1, k)), np.cumsum(w, axis=1)], axis=1)
        flat, slope = np.zeros((p, len(self.levels) + 1, k)), None
        if "t" in parts:
            flat += upto(weights[parts["t"]].reshape(p, -1, k))
        if "h" in parts:
            w = weights[parts["h"]].reshape(p, -1, k)
            flat -= upto(w * self.levels[:, None])
            slope = upto(w)
        if "t" in parts or "h" in parts:
            for j in range(p):
                out += flat[j][self.under[:, j]]
                if slope is not None:
                    out += slope[j][self.under[:, j]] * self.x[:, j, None]
        return out

    def sums(self, r: np.ndarray) -> np.ndarray:
        """(columns, species): sums of ``r`` (rows, species) by the columns."""
        (n, p), k, cells = self.x.shape, r.shape[1], len(self.levels) + 1
        out = [r.sum(0)[None]]
        if "l" in self.codes or not any(c in self.codes for c in "lqpth"):
            out.append(self.x.T @ r)
        if "q" in self.codes:
            out.append((self.x * self.x).T @ r)
        if "p" in self.codes:
            out.append(self.x.prod(1)[None] @ r)
        if "t" in self.codes or "h" in self.codes:
            place = (self.under + np.arange(p) * cells).ravel()
            # sums over the values above each level
            above = lambda v: np.cumsum(np.bincount(place, v.ravel(), p * cells).reshape(p, cells)[:, ::-1], axis=1)[:, -2::-1]
            t = np.stack([above(np.broadcast_to(r[:, i, None], (n, p))) for i in range(k)], axis=2)
            if "t" in self.codes:
                out.append(t.reshape(-1, k))
            if "h" in self.codes:
                h = np.stack([above(self.x * r[:, i, None]) for i in range(k)], axis=2)
                out.append((h - self.levels[:, None] * t).reshape(-1, k))
        return np.concatenate(out)


class LayerMethod(Method):
    """Sums of a round: loss per species, then the gradient (features + 1, species); in the first round squares and products of the features."""

    def __init__(self, spec: Layer, n_species: int):
        self.spec, self.n_species = spec, n_species

    def begin(self, group):
        first = int(group["part"]) * SLICE
        return {"first": first, "n": min(SLICE, self.n_species - first), "squares": None, "worst": None}

    def _features(self, block):
        for low in range(0, len(block.y), _ROWS):
            z = expand(block.x[low:low + _ROWS], self.spec.codes)
            yield slice(low, low + len(z)), np.hstack([np.ones((len(z), 1)), z])

    def _own(self, p: int) -> np.ndarray:
        """(predictors, columns): places, after the intercept, of the columns that come from one predictor alone."""
        found, at = [], 1
        for c in [c for c in "lqpth" if c in self.spec.codes] or ["l"]:
            each = {"p": 0, "t": LEVELS, "h": LEVELS}.get(c, 1)
            found.append(at + np.arange(p * each).reshape(p, each))
            at += p * each or 1
        return np.concatenate(found, axis=1)

    def _products(self, block):
        """Sums of products of the columns of each predictor."""
        codes = self.spec.codes.replace("p", "")
        if self.spec.codes and not codes:
            return np.zeros(0)
        total = 0.0
        for low in range(0, len(block.y), _ROWS):
            each = (expand(column[:, None], codes) for column in block.x[low:low + _ROWS].T)
            total = total + np.stack([z.T @ z for z in each])
        return total

    def needed(self, s):
        """The weights alone: former moves and gradients are 25 times their size."""
        first = s["squares"] is None
        return {"first": s["first"], "n": s["n"], "weights": None if first else self.weights(s)}

    def step(self, s, block):
        s = s if "weights" in s else self.needed(s)
        if s["weights"] is None:
            seen = np.concatenate([*block.labels, np.zeros(0, int)])
            seen = seen[(seen >= s["first"]) & (seen < s["first"] + s["n"])] - s["first"]
            total = sum(np.stack([z.sum(0), (z * z).sum(0)]) for _, z in self._features(block))
            return np.concatenate([[len(block.y), block.x.size], np.bincount(seen, minlength=s["n"]), total.ravel(), self._products(block).ravel()])
        if "label" not in block.memo:
            row = np.repeat(np.arange(len(block.labels)), [len(v) for v in block.labels])
            seen = np.concatenate([*block.labels, np.zeros(0, int)])
            here = (seen >= s["first"]) & (seen < s["first"] + s["n"])
            block.memo["label"] = row[here], seen[here] - s["first"]
        row, seen = block.memo["label"]
        loss, gradient = np.zeros(s["n"]), 0.0
        for low in range(0, len(block.y), _ROWS):
            z = Levels(block.x[low:low + _ROWS], self.spec.codes)
            eta = z.times(s["weights"])
            y = np.zeros_like(eta)
            here = (row >= low) & (row < low + _ROWS)
            y[row[here] - low, seen[here]] = 1
            loss += (np.logaddexp(0, eta) - y * eta).sum(0)
            gradient = gradient + z.sums(1 / (1 + np.exp(-np.clip(eta, -700, 700))) - y)
        return np.concatenate([loss, gradient.ravel()])

    @staticmethod
    def weights(s):
        """Intercept and coefficients on the features as they are; a state's own are on features less their means."""
        return np.vstack([s["beta"][:1] - s["mean"] @ s["beta"][1:], s["beta"][1:]])

    def solve(self, s, sums, rounds):
        s, spec, n = dict(s), self.spec, s["n"]
        if s["squares"] is None:
            rows, seen, own = sums[0], sums[2:2 + n], self._own(int(round(sums[1] / sums[0])))
            products = own.size * own.shape[1]
            total, squares = np.split(sums[2 + n:len(sums) - products], 2)
            start = np.zeros((len(squares), n))
            start[0] = np.log((seen + 0.5) / (rows - seen + 0.5))
            penalty = np.full((len(squares), 1), spec.l2)
            penalty[0] = 0.0  # the intercept is free
            mean = total[1:] / rows
            bend = np.r_[rows, np.maximum(squares[1:] - rows * mean**2, 0)]
            share = (seen + 0.5) / (rows + 1)
            m = mean[own - 1]
            alike = sums[len(sums) - products:].reshape(len(own), own.shape[1], -1) - rows * m[:, :, None] * m[:, None]
            values, vectors = np.linalg.eigh(alike)
            return s | {"squares": squares, "seen": seen, "penalty": penalty, "beta": start, "mean": mean, "last": None, "moves": [],
                        "scale": 1 / (0.25 * bend[:, None] + spec.l2), "own": own, "vectors": vectors,
                        "turned": 1 / (share * (1 - share) * np.maximum(values, 0)[:, :, None] + spec.l2)}, False
        beta = s["beta"]
        size = sums[:n] + 0.5 * (s["penalty"] * beta**2).sum(0)
        g = sums[n:].reshape(beta.shape)
        g = np.vstack([g[:1], g[1:] - s["mean"][:, None] * g[:1]]) + s["penalty"] * beta
        last = s["last"]
        if last is None:
            took = np.ones(n, bool)
        else:
            took = size <= last["size"] + 1e-4 * last["share"] * (last["g"] * last["move"]).sum(0) + 1e-12 * np.abs(last["size"])
            took |= last["share"] < 1e-8
            # species whose step was too long try a shorter one from where they were
            moved = np.where(took, beta - last["beta"], 0), np.where(took, g - last["g"], 0)
            s["moves"] = [*s["moves"], moved][-spec.history:]
            g, size, base = np.where(took, g, last["g"]), np.where(took, size, last["size"]), np.where(took, beta, last["beta"])
            beta = base
        worst = np.maximum(np.abs(g).max(0) / np.sqrt(np.maximum(s["seen"], 1)), np.abs(g[0]) * (spec.tolerance / spec.balance))
        s["worst"], s["beta"] = worst, beta
        if (worst <= spec.tolerance).all() or rounds > spec.rounds:
            return s, True
        fresh = self._direction(s, g, self._bent if rounds > spec.plain else self._scaled)
        move = fresh if last is None else np.where(took, fresh, last["move"])
        share = np.ones(n) if last is None else np.where(took, 1.0, last["share"] / 2)
        share = np.where(worst <= spec.tolerance, 0.0, share)
        s["last"] = {"size": size, "g": g, "beta": beta, "move": move, "share": share}
        s["beta"] = beta + share * move
        return s, False

    @staticmethod
    def _scaled(s, g):
        return s["scale"] * g

    @staticmethod
    def _bent(s, g):
        """``g`` by the inverse of the curvature that the columns of each predictor have at the start."""
        out = s["scale"] * g
        out[s["own"]] = s["vectors"] @ (s["turned"] * (s["vectors"].transpose(0, 2, 1) @ g[s["own"]]))
        return out

    @staticmethod
    def _direction(s, g, bend):
        """Two-loop recursion, one column per species; moves that bend the wrong way are passed over."""
        q, used = g.copy(), []
        for d, y in reversed(s["moves"]):
            dy = (d * y).sum(0)
            rho = np.where(dy > 1e-14, 1 / np.where(dy > 1e-14, dy, 1), 0.0)
            a = rho * (d * q).sum(0)
            q -= a * y
            used.append((d, y, rho, a))
        q = bend(s, q)
        for d, y, rho, a in reversed(used):
            q += d * (a - rho * (y * q).sum(0))
        uphill = (q * g).sum(0) <= 0
        return -np.where(uphill, bend(s, g), q)


def fit_layer(rows: DataFrame, seen: DataFrame, spec: Layer = Layer(), predictors: str = "predictors") -> tuple[DataFrame, DataFrame]:
    """(log, model) of all species of ``seen`` (location_id, species_id) over ``rows`` (location_id, predictors), each row stored once.

    Locations without any species are background for all. ``model``: species_id,
    intercept, coefficients over the expanded features.
    """
    species = seen.select("species_id").distinct()
    # numbered on the driver: one small number per species, thousands at most
    codes = {r["species_id"]: i for i, r in enumerate(species.orderBy("species_id").collect())}
    spark = rows.sparkSession
    numbered = spark.createDataFrame([(int(k), i) for k, i in codes.items()], "species_id bigint, code int")
    labels = seen.distinct().join(F.broadcast(numbered), "species_id").groupBy("location_id").agg(F.sort_array(F.collect_list("code")).alias("labels"))
    ready = pin(rows.select("location_id", predictors).join(labels, "location_id", "left").select(
        F.lit(0).cast("bigint").alias("group_id"), "location_id", predictors, F.coalesce("labels", F.array().cast("array<int>")).alias("labels")))
    method, slices = LayerMethod(spec, len(codes)), -(-len(codes) // SLICE)
    final, _ = fitting.fit(ready, method, 0, predictors, "group_id", parts=slices, slices=slices, fit_if="n > 0")
    final = pin(final)
    names = sorted(codes)
    n_rows = ready.count()

    def table(s) -> list[tuple]:
        w = method.weights(s)
        return [(names[s["first"] + k], float(w[0, k]), w[1:, k], float(s["worst"][k]), int(s["seen"][k]), bool(s["worst"][k] <= spec.tolerance))
                for k in range(s["n"])]

    schema = "species_id bigint, intercept double, coefficients array<double>, worst double, n_presences bigint, converged boolean"
    model = pin(fitting.models(final.withColumn("param", F.lit(None).cast("double")), table, schema.replace("species_id bigint", "species bigint"))
                .drop("species_id", "param").withColumnRenamed("species", "species_id"))
    spent = final.agg(F.max("rounds").alias("rounds"), F.sum("seconds").alias("_s")).select("rounds", (F.col("_s") / len(codes)).alias("seconds"))
    log = model.select("species_id", F.lit(n_rows).alias("n_samples"), "n_presences", F.size("coefficients").alias("n_features"),
                       F.when(F.col("converged"), "ok").otherwise("not converged").alias("status")).withColumns(
        {"rounds": spent.select("rounds").scalar(), "seconds": spent.select("seconds").scalar()})
    return log, model


def score_layer(model: DataFrame, rows: DataFrame, spec: Layer = Layer(), predictors: str = "predictors") -> DataFrame:
    """Probability of every (species, row) pair of ``rows`` (species_id, ..., predictors)."""

    def predict(fields: dict, x: np.ndarray) -> np.ndarray:
        w = np.r_[fields["intercept"].as_py(), fields["coefficients"].values.to_numpy()][:, None]
        return 1 / (1 + np.exp(-np.clip(Levels(x, spec.codes).times(w)[:, 0], -700, 700)))

    return fitting.score(model.select("species_id", "intercept", "coefficients"), rows, predict, predictors)
