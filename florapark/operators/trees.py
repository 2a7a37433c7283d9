"""Forests and boosted trees from histograms, for all species at once (see ``fitting``).

Predictors are compared with quantile edges, ``bins`` - 1 of them per predictor. A tree is
a table of nodes: feature (-1 at a leaf), edge, left, right, value. Both methods ask the
blocks for sums per (node, feature, bin) of the nodes they want to split next.

*Forest.* Every tree sees a balanced bootstrap: of each class as many rows as the smaller
class has, drawn by hash of (tree, location), and each of them a Poisson(1) number of
times. Every node draws its own features. All trees of a part grow together, level by
level, at most ``NODES`` nodes a round.

*Boosting.* Trees grow leaf by leaf (best first) up to ``leaves``, or level by level up to
``depth``. A tree sees a part of the rows, drawn by hash of (tree, location). Scores are
kept with the rows and moved on by the newest tree only, so work is linear in trees. The
number of trees is settled on held-out rows where there are some.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from florapark.operators import fitting
from florapark.operators.fitting import Block, Method
from florapark.session import pin

NODES = 2048  # nodes of a forest part that are split in one round
_TOGETHER = 50  # trees that are joined to a block of rows at once
_U = np.uint64


def _draw(seed: int, number: np.ndarray | int, key: np.ndarray) -> np.ndarray:
    """Repeatable numbers in [0, 1) from (seed, number, key)."""
    with np.errstate(over="ignore"):
        h = key.astype(_U) * _U(0x9E3779B97F4A7C15) + np.asarray(number).astype(_U) * _U(0xD1B54A32D192ED03) + _U(seed % (1 << 63) + 1) * _U(0x8CB92BA72F3D8DD7)
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        h = h ^ (h >> _U(31))
    return (h >> _U(11)).astype(float) / float(1 << 53)


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))  # P(count <= k) at a mean of 1


def _binned(block: Block, edges: np.ndarray) -> np.ndarray:
    """Bin of every value: the number of edges below it."""
    if "bins" not in block.shared:
        out = np.empty(block.x.shape, np.int32)
        for j in range(block.x.shape[1]):
            out[:, j] = np.searchsorted(edges[j], block.x[:, j], side="left")
        block.shared["bins"] = out
    return block.shared["bins"]


# ---- forest ----


@dataclass(frozen=True)
class Forest:
    """``max_features`` 0 takes the square root of the number of predictors; a species' own value, where there is one, goes first."""

    trees: int = 1000
    max_features: int = 0
    depth: int = 24
    min_leaf: int = 5
    bins: int = 32
    bootstrap: bool = True
    seed: int = 0
    part_trees: int = 32


class ForestMethod(Method):
    def __init__(self, spec: Forest):
        self.spec = spec

    def begin(self, group):
        spec, p = self.spec, int(group["p"])
        groups = -(-spec.trees // spec.part_trees)
        first = int(group["part"]) % groups * spec.part_trees
        n = min(spec.part_trees, spec.trees - first)
        param = group["param"]
        tried = spec.max_features if param is None or np.isnan(param) else int(param)
        n_pos, n_neg = int(group["n_pos"]), int(group["n"] - group["n_pos"])
        return {
            "edges": np.asarray(group["edges"], float).reshape(p, -1), "tried": min(p, tried or max(1, int(np.sqrt(p)))), "group": int(group["group_id"]),
            "rate": (min(n_pos, n_neg) / n_neg, min(n_pos, n_neg) / n_pos), "tree": np.arange(first, first + n), "roots": n,
            # the right child of a node follows its left one
            "feature": np.full(n, -1, np.int16), "cut": np.zeros(n, np.int16), "left": np.full(n, -1, np.int32), "level": np.zeros(n, np.int16),
            "of": np.arange(n, dtype=np.int16), "open": np.arange(n), "weights": np.zeros((n, 2))}

    def _pairs(self, s, block):
        """(row, node, count, class) of every row that a tree drew; nodes are followed from where they stood last."""
        memo = block.memo
        if "row" not in memo:
            spec, y = self.spec, (block.y > 0).astype(int)
            if spec.bootstrap:
                key = block.key[:, None]
                row, tree = np.nonzero(_draw(spec.seed * 2, s["tree"], key) < np.asarray(s["rate"])[y][:, None])
                times = np.searchsorted(_POISSON, _draw(spec.seed * 2 + 1, s["tree"][tree], block.key[row]))
                row, tree, times = row[times > 0], tree[times > 0], times[times > 0]
            else:
                row, tree = np.divmod(np.arange(len(y) * s["roots"]), s["roots"])
                times = np.ones(len(row), int)
            memo["row"], memo["node"], memo["times"] = row, tree, times.astype(float)
            memo["y"] = y[row]
        bins = _binned(block, s["edges"])
        flat, p = bins.ravel(), bins.shape[1]
        while True:
            node = memo["node"]
            f = s["feature"][node]
            at = np.flatnonzero(f >= 0)
            if not len(at):
                break
            here = node[at]
            node[at] = s["left"][here] + (flat[memo["row"][at] * p + f[at]] > s["cut"][here])
        return memo["row"], node, memo["times"], memo["y"]

    def _open_pairs(self, s, block):
        """Those of ``_pairs`` that stand in an open node; the others have nothing more to say and are forgotten."""
        self._pairs(s, block)
        open_ = np.zeros(len(s["feature"]), bool)
        open_[s["open"]] = True
        memo, stay = block.memo, open_[block.memo["node"]]
        if not stay.all():
            for name in ("row", "node", "times", "y"):
                memo[name] = memo[name][stay]
        return memo["row"], memo["node"], memo["times"], memo["y"]

    def _round(self, s):
        """Nodes to split now and the features each of them tries."""
        nodes = s["open"][:NODES]
        p = len(s["edges"])
        draw = _draw(self.spec.seed + 7, (s["tree"][s["of"][nodes]].astype(np.int64) * 4_000_037 + nodes)[:, None], np.arange(p)[None, :] + s["group"] * 1_000_003)
        return nodes, np.argsort(draw, axis=1)[:, :s["tried"]]

    def step(self, s, block):
        nodes, tried = self._round(s)
        slot = np.full(len(s["feature"]), -1)
        slot[nodes] = np.arange(len(nodes))
        row, node, times, y = self._open_pairs(s, block)
        place, bins, b = slot[node], _binned(block, s["edges"]), s["edges"].shape[1] + 1
        if len(nodes) < len(s["open"]):
            at = np.flatnonzero(place >= 0)
            place, row, times, y = place[at], row[at], times[at], y[at]
        flat, first, cells = bins.ravel(), row * bins.shape[1], tried.shape[1] * b * 2
        base, out = place * cells + y, 0
        for k in range(tried.shape[1]):
            out = out + np.bincount(base + 2 * (flat[first + tried[:, k][place]] + k * b), times, len(nodes) * cells)
        return out

    def solve(self, s, sums, rounds):
        spec = self.spec
        nodes, tried = self._round(s)
        hist = sums.reshape(len(nodes), tried.shape[1], -1, 2)
        total = hist[:, 0].sum(1)
        s["weights"][nodes] = total
        # one table per class: sums over an axis of two are slow
        l0, l1 = (np.cumsum(hist[..., c], axis=2)[:, :, :-1] for c in (0, 1))
        r0, r1 = (total[:, c, None, None] - l for c, l in enumerate((l0, l1)))
        nl, nr = l0 + l1, r0 + r1
        with np.errstate(divide="ignore", invalid="ignore"):
            # sum of squares per side: the larger, the purer
            gain = (l0 * l0 + l1 * l1) / nl + (r0 * r0 + r1 * r1) / nr
        gain[(nl < spec.min_leaf) | (nr < spec.min_leaf)] = -np.inf
        flat = gain.reshape(len(nodes), -1)
        best = flat.argmax(1)
        k, c = np.unravel_index(best, gain.shape[1:])
        pure = (total.min(1) == 0) | (total.sum(1) < 2 * spec.min_leaf) | (s["level"][nodes] >= spec.depth)
        split = np.flatnonzero(~pure & np.isfinite(flat[np.arange(len(nodes)), best]))
        at, n = nodes[split], len(s["feature"])
        child = n + np.arange(2 * len(at))
        s["feature"][at], s["cut"][at] = tried[split, k[split]], c[split]
        s["left"][at] = child[0::2]
        fresh = len(child)
        own = split, k[split], c[split]
        sides = np.stack([l0[own], l1[own], r0[own], r1[own]], 1).reshape(-1, 2)
        for name, values in (("feature", np.full(fresh, -1)), ("cut", np.zeros(fresh)), ("left", np.full(fresh, -1)),
                             ("level", np.repeat(s["level"][at] + 1, 2)), ("of", np.repeat(s["of"][at], 2))):
            s[name] = np.concatenate([s[name], values.astype(s[name].dtype)])
        s["weights"] = np.concatenate([s["weights"], sides])
        # children that cannot be split need no sums
        can = (sides.min(1) > 0) & (sides.sum(1) >= 2 * spec.min_leaf) & (s["level"][child] < spec.depth)
        s["open"] = np.concatenate([s["open"][len(nodes):], child[can]])
        return s, not len(s["open"])

    @staticmethod
    def tables(s) -> list[tuple[int, np.ndarray, int]]:
        """(tree, nodes as rows (feature, cut value, left, right, share of presences), depth) of a finished state."""
        value = s["weights"][:, 1] / np.maximum(s["weights"].sum(1), 1e-300)
        cut = np.where(s["feature"] >= 0, s["edges"][np.maximum(s["feature"], 0), np.minimum(s["cut"], s["edges"].shape[1] - 1)], 0.0)
        order = np.argsort(s["of"], kind="stable")
        place = np.empty(len(order), int)
        starts = np.searchsorted(s["of"][order], np.arange(s["roots"] + 1))
        place[order] = np.arange(len(order)) - np.repeat(starts[:-1], np.diff(starts))
        child = lambda side: np.where(s["feature"] >= 0, place[np.minimum(np.maximum(s["left"], 0) + side, len(place) - 1)], -1)
        rows = np.stack([s["feature"], cut, child(0), child(1), value], 1)[order]
        return [(int(s["tree"][t]), rows[a:b], int(s["level"][order[a:b]].max())) for t, (a, b) in enumerate(zip(starts[:-1], starts[1:]))]


def rate_part(s, x: np.ndarray) -> np.ndarray:
    """Mean share of presences in the leaves that each row of ``x`` reaches in the trees of a finished state; all trees are walked at once."""
    inner, roots = s["feature"] >= 0, s["roots"]
    feature = np.maximum(s["feature"], 0).astype(np.int64)
    cut, left = s["edges"][feature, np.minimum(s["cut"], s["edges"].shape[1] - 1)], s["left"].astype(np.int64)
    value = s["weights"][:, 1] / np.maximum(s["weights"].sum(1), 1e-300)
    at, flat = np.tile(np.arange(roots), len(x)), np.ascontiguousarray(x).ravel()
    moving, here = np.arange(len(at)), at
    first = moving // roots * x.shape[1]
    while len(moving):
        stay = inner[here]
        moving, here, first = moving[stay], here[stay], first[stay]
        here = left[here] + ~(flat[first + feature[here]] <= cut[here])
        at[moving] = here
    return value[at].reshape(len(x), roots).mean(1)


def follow(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Value of the leaf that each row reaches in a table of (feature, cut, left, right, value) rows."""
    at, feature = np.zeros(len(x), int), nodes[:, 0].astype(int)
    moving = np.arange(len(x))
    while len(moving):
        f = feature[at[moving]]
        moving, f = moving[f >= 0], f[f >= 0]
        here = nodes[at[moving]]
        at[moving] = np.where(x[moving, f] <= here[:, 1], here[:, 2], here[:, 3]).astype(int)
    return nodes[at, 4]


# ---- boosting ----


@dataclass(frozen=True)
class Boosted:
    """``leaves`` 0 grows level by level to ``depth``; else leaf by leaf, the best first. ``patience`` 0 keeps all trees."""

    trees: int = 500
    depth: int = 5
    leaves: int = 0
    learning_rate: float = 0.05
    subsample: float = 0.8
    bins: int = 32
    shrink: float = 1.0
    min_leaf: int = 1
    patience: int = 0
    seed: int = 0


class BoostedMethod(Method):
    """Sums of a round: held-out loss, its rows, loss of all rows; then gradient, curvature and rows per (leaf asked for, feature, bin)."""

    carries = True

    def __init__(self, spec: Boosted):
        self.spec = spec

    def begin(self, group):
        p = int(group["p"])
        param = group["param"]
        leaves = self.spec.leaves if param is None or np.isnan(param) else int(param) + 1  # tc interactions need tc + 1 leaves
        return {"edges": np.asarray(group["edges"], float).reshape(p, -1), "bias": float(np.log((group["n_pos"] + 0.5) / (group["n"] - group["n_pos"] + 0.5))),
                "leaves": leaves, "trees": [], "tree": self._seedling(), "ask": [0], "best": (np.inf, 0)}

    @staticmethod
    def _seedling():
        # per node: feature, bin, left, right, value, level; sums of gradient and curvature; the best split of leaves that were asked for
        return {"nodes": [[-1, 0, -1, -1, 0.0, 0]], "sums": {}, "options": {}}

    def _moved(self, s, block):
        """Scores of the rows by all finished trees."""
        memo = block.memo
        if "score" not in memo:
            memo["score"], memo["seen"] = np.full(len(block.y), s["bias"]), 0
        bins = _binned(block, s["edges"])
        for number in range(memo["seen"], len(s["trees"])):
            nodes = s["trees"][number]
            memo["score"] = memo["score"] + np.array([n[4] for n in nodes])[self._reached(memo, number, nodes, bins)]
        if memo["seen"] != len(s["trees"]) or "g" not in memo:
            memo["seen"] = len(s["trees"])
            mu = 1 / (1 + np.exp(-np.clip(memo["score"], -35, 35)))
            rows = np.flatnonzero((block.held == 0) & (_draw(self.spec.seed, len(s["trees"]), block.key) < self.spec.subsample))
            g, h = block.w * (block.y - mu), block.w * np.maximum(mu * (1 - mu), 1e-9)
            if "places" not in memo:  # of each value among the bins of a node, predictor by predictor
                memo["places"] = np.ascontiguousarray(bins.T) + np.arange(0, bins.shape[1] * (s["edges"].shape[1] + 1), s["edges"].shape[1] + 1)[:, None]
            memo["g"], memo["h"], memo["drawn"], memo["at"] = g[rows], h[rows], rows, memo["places"].take(rows, axis=1)
            memo["loss"] = np.zeros(3)
            if self.spec.patience:  # nothing else asks for it
                loss = -block.w * np.where(block.y > 0, np.log(mu), np.log1p(-mu))
                memo["loss"] = np.array([loss[block.held > 0].sum(), (block.held > 0).sum(), loss.sum()])
        return bins

    @staticmethod
    def _reached(memo, number, nodes, bins):
        """Node where every row stands in tree ``number``; rows go on from where they stood in it last."""
        if memo.get("of") != number:
            memo["of"], memo["node"], memo["known"] = number, np.zeros(len(bins), np.int64), 1
        if "first" not in memo:
            memo["first"] = np.arange(0, bins.size, bins.shape[1])
        # a row in a leaf stays; the right child of a node follows its left one
        feature, cut, left = np.zeros(len(nodes), np.int64), np.full(len(nodes), np.iinfo(np.int32).max, np.int32), np.arange(len(nodes))
        moves = [0] * len(nodes)  # that a row may have ahead to reach the node from one that was there before
        for k, n in enumerate(nodes):
            if n[0] >= 0:
                feature[k], cut[k], left[k] = n[:3]
                if n[2] >= memo["known"]:
                    moves[n[2]] = moves[n[3]] = moves[k] + 1
        at, flat = memo["node"], bins.ravel()
        for _ in range(max(moves)):
            at = left[at] + (flat[memo["first"] + feature[at]] > cut[at])
        memo["node"], memo["known"] = at, len(nodes)
        return at

    def step(self, s, block):
        bins = self._moved(s, block)
        m, b, asked, p = block.memo, s["edges"].shape[1] + 1, s["ask"], len(s["edges"])
        nodes = s["tree"]["nodes"]
        slot = np.full(len(nodes), -1)
        slot[asked] = np.arange(len(asked)) * (p * b)
        place, at, g, h = slot[self._reached(m, len(s["trees"]), nodes, bins)[m["drawn"]]], m["at"], m["g"], m["h"]
        keep = np.flatnonzero(place >= 0)
        if len(keep) < len(place):
            place, at, g, h = place[keep], at.take(keep, axis=1), g[keep], h[keep]
        where, cells = (at + place).ravel(), len(asked) * p * b
        out = np.empty((cells, 3))
        for k, v in enumerate((g, h)):
            out[:, k] = np.bincount(where, np.tile(v, p), cells)
        out[:, 2] = np.bincount(where, minlength=cells)
        return np.concatenate([m["loss"], out.ravel()])

    def solve(self, s, sums, rounds):
        spec, tree, p = self.spec, s["tree"], len(s["edges"])
        if s["ask"] == [0]:  # the root of a new tree: the loss is that of the trees before it
            loss = sums[0] if sums[1] > 0 else sums[2]
            if loss < s["best"][0]:
                s["best"] = (loss, len(s["trees"]))
            elif spec.patience and len(s["trees"]) - s["best"][1] >= spec.patience:
                return s, True
            if len(s["trees"]) >= spec.trees:
                return s, True
        hist = sums[3:].reshape(len(s["ask"]), p, -1, 3)
        for node, option, total in zip(s["ask"], *self._options(hist)):
            tree["options"][node], tree["sums"][node] = option, total
        if s["leaves"] == 0:
            chosen = [k for k in s["ask"] if tree["options"][k][0] > 0 and tree["nodes"][k][5] < spec.depth]
        else:
            open_leaves = [k for k, o in tree["options"].items() if tree["nodes"][k][0] < 0 and o[0] > 0]
            chosen = sorted(open_leaves, key=lambda k: (-tree["options"][k][0], k))[:1]
        fresh = []
        for k in chosen:
            fresh += self._split(tree, k)
        n_leaves = sum(n[0] < 0 for n in tree["nodes"])
        full = n_leaves >= s["leaves"] if s["leaves"] else fresh and tree["nodes"][fresh[0]][5] >= spec.depth
        if fresh and not full:
            s["ask"] = fresh
            return s, False
        for k, n in enumerate(tree["nodes"]):
            if n[0] < 0:
                g, h = tree["sums"][k]
                n[4] = spec.learning_rate * g / (h + spec.shrink)
        s["trees"].append(tree["nodes"])
        s["tree"], s["ask"] = self._seedling(), [0]
        return s, False

    def _options(self, hist):
        """(gain, feature, bin, sums of the left and right side) of the best split of each leaf, and the sums of the leaves."""
        spec, total = self.spec, hist[:, 0].sum(1)
        left = np.cumsum(np.moveaxis(hist, 3, 0), axis=3)[..., :-1]
        right = total.T[:, :, None, None] - left
        part = lambda g, h: g ** 2 / (h + spec.shrink)
        gain = part(left[0], left[1]) + part(right[0], right[1]) - part(total[:, 0], total[:, 1])[:, None, None]
        gain[(left[2] < spec.min_leaf) | (right[2] < spec.min_leaf)] = -np.inf
        best = gain.reshape(len(gain), -1).argmax(1)
        f, c = np.unravel_index(best, gain.shape[1:])
        k = np.arange(len(gain))
        sides = left[:2, k, f, c].T, right[:2, k, f, c].T
        return [(float(gain[i, f[i], c[i]]), int(f[i]), int(c[i]), (sides[0][i], sides[1][i])) for i in k], total[:, :2]

    @staticmethod
    def _split(tree, k):
        _, f, c, sides = tree["options"].pop(k)
        n, node = len(tree["nodes"]), tree["nodes"][k]
        node[:4] = f, c, n, n + 1
        tree["nodes"] += [[-1, 0, -1, -1, 0.0, node[5] + 1] for _ in sides]
        tree["sums"][n], tree["sums"][n + 1] = sides
        return [n, n + 1]

    def carry(self, block):
        return np.concatenate([[block.memo["seen"]], block.memo["score"]])

    def resume(self, block, carried):
        block.memo["seen"], block.memo["score"] = int(carried[0]), carried[1:].copy()

    def tables(self, s) -> tuple[float, int, np.ndarray]:
        """(bias, trees kept, rows (tree, feature, cut value, left, right, value)) of a finished state."""
        kept = s["best"][1] if self.spec.patience else len(s["trees"])
        out = []
        for t, nodes in enumerate(s["trees"][:kept]):
            a = np.asarray(nodes, float)
            f = np.maximum(a[:, 0], 0).astype(int)
            cut = np.where(a[:, 0] >= 0, s["edges"][f, np.minimum(a[:, 1], s["edges"].shape[1] - 1).astype(int)], 0.0)
            out.append(np.column_stack([np.full(len(a), t), a[:, 0], cut, a[:, 2:5]]))
        return s["bias"], kept, np.concatenate(out) if out else np.zeros((0, 6))


def boosted_score(bias: float, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Probability of each row of ``x`` by trees given as rows (tree, feature, cut, left, right, value)."""
    out = np.full(len(x), bias)
    starts = np.flatnonzero(np.r_[True, np.diff(rows[:, 0]) > 0]) if len(rows) else []
    for a, b in zip(starts, [*starts[1:], len(rows)]):
        out += follow(rows[a:b, 1:], x)
    return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


# ---- all species ----


def fit_forest(train: DataFrame, spec: Forest = Forest(), predictors: str = "predictors", params: DataFrame | None = None,
               grid: Sequence[float] = ()) -> tuple[DataFrame, DataFrame]:
    """(log, trees): one row per (species_id, param, tree) with its nodes (feature, cut, left, right, value), flattened, and its depth.

    A parameter value is the number of predictors that a node tries.
    """
    final, described = _grown(train, spec, predictors, params, grid)

    def table(s) -> list[tuple]:
        return [(tree, nodes.ravel(), depth) for tree, nodes, depth in ForestMethod.tables(s)]

    return fitting.fit_log(final, described), fitting.models(final, table, "tree int, nodes array<double>, depth int")


def _grown(train: DataFrame, spec: Forest, predictors: str, params: DataFrame | None, grid: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    groups = -(-spec.trees // spec.part_trees)
    final, described = fitting.fit(train, ForestMethod(spec), spec.bins, predictors, params=params, grid=grid, parts=groups, slices=groups)
    return pin(final), described


def fit_parts(train: DataFrame, spec: Forest = Forest(), predictors: str = "predictors", params: DataFrame | None = None,
              grid: Sequence[float] = ()) -> tuple[DataFrame, DataFrame]:
    """(log, parts): the trees of ``fit_forest`` as they were grown, ``part_trees`` of a species in one row (species_id, param, state, weight)."""
    final, described = _grown(train, spec, predictors, params, grid)
    groups = -(-spec.trees // spec.part_trees)
    weight = F.least(F.lit(spec.part_trees), spec.trees - F.pmod("part", F.lit(groups)) * spec.part_trees)
    parts = final.where("state is not null and message is null").select(F.col("group_id").alias("species_id"), "param", "state", weight.alias("weight"))
    return fitting.fit_log(final, described), parts


def score_parts(parts: DataFrame, rows: DataFrame, predictors: str = "predictors", by: Sequence[str] = ()) -> DataFrame:
    """``score_forest`` by the rows of ``fit_parts``."""
    return fitting.score(parts, rows, lambda fields, x: rate_part(fitting.opened(fields["state"].as_py()), x), predictors, by)


def score_forest(trees: DataFrame, rows: DataFrame, predictors: str = "predictors", by: Sequence[str] = ()) -> DataFrame:
    """Mean share of presences in the leaves that a row reaches; trees meet the rows ``_TOGETHER`` at a time."""
    part = F.floor(F.col("tree") / _TOGETHER)
    model = trees.groupBy("species_id", *by, part.alias("_part")).agg(
        F.collect_list("nodes").alias("trees"), F.count("*").alias("weight")).drop("_part")

    def predict(fields: dict, x: np.ndarray) -> np.ndarray:
        tables = [np.asarray(t.values).reshape(-1, 5) for t in fields["trees"]]
        return np.mean([follow(t, x) for t in tables], axis=0)

    return fitting.score(model, rows, predict, predictors, by)


def fit_boosted(train: DataFrame, spec: Boosted = Boosted(), predictors: str = "predictors", params: DataFrame | None = None,
                grid: Sequence[float] = (), holdout: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(log, model): bias, number of trees kept and rows (tree, feature, cut, left, right, value), flattened, per species.

    With ``patience``, a share ``holdout`` of either class is held out to settle the number
    of trees. A parameter value is the number of splits of a tree.
    """
    method = BoostedMethod(spec)
    final, described = fitting.fit(train, method, spec.bins, predictors, params=params, grid=grid, holdout=(holdout, spec.seed) if spec.patience else None)
    final = pin(final)

    def table(s) -> list[tuple]:
        bias, kept, nodes = method.tables(s)
        return [(bias, kept, nodes.ravel(), len(s["trees"]))]

    model = pin(fitting.models(final, table, "bias double, n_trees int, nodes array<double>, grown int"))
    facts = model.select("species_id", "param", "n_trees", "grown")
    log = fitting.fit_log(final, described).alias("l").join(facts.alias("m"), F.expr("l.species_id = m.species_id and l.param <=> m.param"), "left")
    used = (F.col("grown") >= spec.trees) & F.lit(spec.patience > 0)
    return log.select("l.*", "n_trees", "grown").withColumn(
        "status", F.when(used, "all trees used").otherwise(F.col("status"))).drop("grown"), model


def score_boosted(model: DataFrame, rows: DataFrame, predictors: str = "predictors", by: Sequence[str] = ()) -> DataFrame:
    """Probability of every row by the trees of its species."""

    def predict(fields: dict, x: np.ndarray) -> np.ndarray:
        return boosted_score(fields["bias"].as_py(), np.asarray(fields["nodes"].values).reshape(-1, 6), x)

    return fitting.score(model, rows, predict, predictors, by)
