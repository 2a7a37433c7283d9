"""Iterative fits of many units at once: rows in blocks, sums per block, one small solve per unit.

A *unit* is (group_id, part): a species with a parameter value, with a run of trees, or a
shared set of rows with a slice of species. The rows of a group are packed into blocks of
about ``BLOCK_ROWS``. A round adds up a method's sums over the blocks of a unit and lets
the method solve for the next state.

Groups of at most ``LOCAL_ROWS`` rows run all their rounds inside one task, which gets
their rows by one shuffle, describes them itself and holds them as one block, with which
methods may keep running scores. Larger groups are described and packed first and take
one Spark pass per round: their blocks are spread over the cluster, the sums meet per
unit, and what a method carries along per row is written down with the block. Both ways
call the same two functions, so no task ever holds more than a bounded number of rows.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import time
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from florapark.operators.sampling import stratified_holdout
from florapark.session import drop, pin, ship

BLOCK_ROWS = 2048
LOCAL_ROWS = 1 << 15
SLICE_ROWS = 1 << 15  # rows of a group that are looked at together once it is fitted
MOST_ROUNDS = 100_000  # a method ends by itself; this only stops one that does not
_GROUPS_PER_CORE = 4  # groups, or slices of them, that keep a core busy to the end
_GROUPS_PER_TASK = 16
_BLOCKS_PER_TASK = 16
HELD_UNITS = 64  # partial sums a task holds before they are passed on
HELD_BYTES = 1 << 22  # model rows a task holds before they are passed on

BLOCK = "group_id bigint, block int, n int, p int, key array<bigint>, x array<double>, y array<double>, w array<double>, held array<double>, labels array<array<int>>"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
_ROW_COLUMNS = (("label", "y", 0.0), ("weight", "w", 1.0), ("holdout", "h", 0.0))  # column, short name, value where there is no such column
STATE = "group_id bigint, part int, param double, state binary, done boolean, rounds int, seconds double, message string"


def _keep(state) -> bytes:
    return zlib.compress(pickle.dumps(state), 1)


def opened(kept: bytes):
    return pickle.loads(zlib.decompress(kept))


@dataclass
class Block:
    """Rows of one group: keys, predictors (n, p), labels, weights, held-out marks; ``memo`` is the method's own for one unit, ``shared`` for all units of the group."""

    key: np.ndarray
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    held: np.ndarray
    labels: list | None = None
    memo: dict = field(default_factory=dict)
    shared: dict = field(default_factory=dict)


class Method:
    """What a fit has to say; all arrays are numpy. ``carries`` asks for ``carry`` to be kept per row between rounds."""

    carries = False

    def begin(self, group: dict) -> object:
        """First state of a unit; ``group`` has group_id, part, param, n, n_pos, p and the arrays lo, hi, edges."""
        raise NotImplementedError

    def step(self, state, block: Block) -> np.ndarray:
        """Sums of one block; they are added up over the blocks of the unit."""
        raise NotImplementedError

    def solve(self, state, sums: np.ndarray, rounds: int) -> tuple[object, bool]:
        """(next state, whether the unit is done)."""
        raise NotImplementedError

    def needed(self, state) -> object:
        """What of a state ``step`` reads; it goes to every block in every round, the rest stays with the unit."""
        return state

    def carry(self, block: Block) -> np.ndarray:
        """Numbers per row to be written with the block of a large group."""
        return np.zeros(0)

    def resume(self, block: Block, carried: np.ndarray) -> None:
        """Put back what ``carry`` gave."""


def is_packed(train: DataFrame) -> bool:
    """Whether rows of ``train`` hold several locations (n, p, keys, xs), see ``sampling.training_table``."""
    return "keys" in train.columns


def unpacked(train: DataFrame, predictors: str = "predictors") -> DataFrame:
    """``train`` with a row (..., location_id, predictors) per location."""
    if not is_packed(train):
        return train
    rest = [c for c in train.columns if c not in ("n", "p", "keys", "xs")]
    return train.select(*rest, "p", "xs", F.posexplode("keys").alias("_i", "location_id")).select(
        *rest, "location_id", F.slice("xs", F.col("_i") * F.col("p") + 1, F.col("p")).alias(predictors))


def pack(train: DataFrame, predictors: str = "predictors", group: str = "species_id", tasks: int | None = None) -> DataFrame:
    """Rows (group, location_id, predictors, [label, weight, holdout, labels]) as blocks; a row goes to a block by hash.

    Blocks are few bytes for the work they call for; ``tasks`` spreads them by their number.
    """
    have = train.columns
    sizes = train.groupBy(group).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_blocks"))
    row = F.struct(
        F.col("location_id").cast("bigint").alias("k"), F.transform(predictors, lambda v: v.cast("double")).alias("x"),
        *[(F.col(c).cast("double") if c in have else F.lit(d)).alias(a) for c, a, d in _ROW_COLUMNS],
        (F.col("labels") if "labels" in have else F.lit(None).cast("array<int>")).alias("l"))
    block = F.pmod(F.xxhash64("location_id", F.lit(11)), F.col("_blocks")).cast("int")
    # sorted, so that a block written twice is the same block
    placed = train.join(sizes, group).withColumn("block", block)
    placed = placed.repartition(tasks, group, "block") if tasks else placed
    packed = placed.groupBy(group, "block").agg(F.sort_array(F.collect_list(row)).alias("r"))
    take = lambda name: F.transform("r", lambda r: r[name])
    return packed.select(
        F.col(group).cast("bigint").alias("group_id"), "block", F.size("r").alias("n"), F.size(F.get(take("x"), 0)).alias("p"),
        take("k").alias("key"), F.flatten(take("x")).alias("x"), take("y").alias("y"), take("w").alias("w"), take("h").alias("held"),
        (take("l") if "labels" in have else F.lit(None).cast("array<array<int>>")).alias("labels"))


def _sizes(train: DataFrame, predictors: str, group: str) -> DataFrame:
    """(group_id, n, n_pos, p): rows, presences and predictors of each group."""
    if is_packed(train):
        return train.groupBy(F.col(group).cast("bigint").alias("group_id")).agg(
            F.sum("n").alias("n"), F.sum(F.when(F.col("label") > 0, F.col("n")).otherwise(0)).alias("n_pos"), F.max("p").alias("p"))
    n_pos = F.count_if(F.col("label") > 0) if "label" in train.columns else F.lit(0).cast("bigint")
    return train.groupBy(F.col(group).cast("bigint").alias("group_id")).agg(
        F.count("*").alias("n"), n_pos.alias("n_pos"), F.max(F.size(predictors)).alias("p"))


def describe(train: DataFrame, bins: int, predictors: str = "predictors", group: str = "species_id") -> DataFrame:
    """(group_id, n, n_pos, p, lo, hi, edges): ranges of each predictor and its ``bins`` - 1 inner quantiles, one after the other."""
    v = F.col("v").cast("double")
    edges = F.percentile_approx(v, F.array(*[F.lit(i / bins) for i in range(1, bins)]), 2000) if bins > 1 else F.lit(None).cast("array<double>")
    each = train.select(F.col(group).cast("bigint").alias("group_id"), F.posexplode(predictors).alias("j", "v")).groupBy("group_id", "j").agg(
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.coalesce(edges, F.array().cast("array<double>")).alias("e"))
    arrays = each.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("j", "lo", "hi", "e"))).alias("s"))
    field_of = lambda name: F.transform("s", lambda r: r[name])
    return _sizes(train, predictors, group).join(arrays, "group_id").select(
        "group_id", "n", "n_pos", "p", field_of("lo").alias("lo"), field_of("hi").alias("hi"), F.flatten(field_of("e")).alias("edges"))


def _described(x: np.ndarray, bins: int) -> dict:
    """What ``describe`` says of the predictors, from the rows of a group; here the quantiles are exact."""
    edges = []
    for v in x.T:
        v = np.sort(v[~np.isnan(v)])
        at = np.ceil(np.arange(1, bins) / bins * len(v)).astype(int) - 1
        edges.append(v[np.maximum(at, 0)] if len(v) else np.full(max(bins - 1, 0), np.nan))
    return {"lo": np.fmin.reduce(x), "hi": np.fmax.reduce(x), "edges": np.concatenate(edges) if edges else np.zeros(0)}


def _block(r) -> Block:
    n = int(r.n)
    return Block(np.asarray(r.key, np.int64), np.asarray(r.x, float).reshape(n, int(r.p)), np.asarray(r.y, float), np.asarray(r.w, float),
                 np.asarray(r.held, float), None if r.labels is None else [np.asarray(v, np.int64) for v in r.labels])


def _rows(train: DataFrame, predictors: str, group: str) -> DataFrame:
    """(group_id, k, x, and of y, w, h, l those that ``train`` has a column for): rows as tasks get them."""
    have = train.columns
    k, x = ("keys", "xs") if is_packed(train) else ("location_id", predictors)
    return train.select(
        F.col(group).cast("bigint").alias("group_id"), F.col(k).cast("array<bigint>" if is_packed(train) else "bigint").alias("k"), F.col(x).cast("array<double>").alias("x"),
        *[F.col(c).cast("double").alias(a) for c, a, _ in _ROW_COLUMNS if c in have], *([F.col("labels").alias("l")] if "labels" in have else []))


def _block_of(rows: pa.Table) -> Block:
    """Rows of one group in the order of their keys."""
    if pa.types.is_list(rows.schema.field("k").type):
        return _block_of_packed(rows)
    rows = rows.sort_by("k")
    whole = lambda name: rows.column(name).combine_chunks()
    n, names = rows.num_rows, rows.column_names
    number = lambda name: whole(name).to_numpy(zero_copy_only=False).astype(float)
    y, w, held = (number(a) if a in names else np.full(n, d) for _, a, d in _ROW_COLUMNS)
    labels = [np.asarray(v, np.int64) for v in whole("l").to_pylist()] if "l" in names else None
    x = whole("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
    return Block(whole("k").to_numpy(zero_copy_only=False).astype(np.int64), x, y, w, held, labels)


def _block_of_packed(rows: pa.Table) -> Block:
    whole = lambda name: rows.column(name).combine_chunks()
    key = whole("k").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    order, each = np.argsort(key, kind="stable"), whole("k").value_lengths().to_numpy(zero_copy_only=False)
    number = lambda name: np.repeat(whole(name).to_numpy(zero_copy_only=False).astype(float), each)[order]
    y, w, held = (number(a) if a in rows.column_names else np.full(len(key), d) for _, a, d in _ROW_COLUMNS)
    x = whole("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(key), -1)
    return Block(key[order], x[order], y, w, held)


def begin(units: DataFrame, described: DataFrame, method: Method) -> DataFrame:
    """State table of ``units`` (group_id, part, param)."""

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r["group_id"], r["part"], r["param"], _keep(method.begin(r)), False, 0, 0.0, None) for r in b.to_dict("records")]
            yield pd.DataFrame(rows, columns=["group_id", "part", "param", "state", "done", "rounds", "seconds", "message"])

    return units.join(described, "group_id").mapInPandas(start, STATE)


def fit(train: DataFrame, method: Method, bins: int = 0, predictors: str = "predictors", group: str = "species_id", params: DataFrame | None = None,
        grid: Sequence[float] = (), parts: int = 1, slices: int = 1, fit_if: str = "n_pos > 0 and n_pos < n",
        holdout: tuple[float, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(final state table, (group_id, n, n_pos, p)); groups that ``fit_if`` excludes are done at once, without a state.

    For ``params``, ``grid`` and ``parts`` see ``units``; ``bins`` is that of ``describe``.
    ``slices`` spreads the parts of a group that fits in one task over up to so many tasks, where there are fewer groups than cores call for:
    the rows of a group go to each of its tasks. ``holdout`` (share, seed) marks rows as ``sampling.stratified_holdout`` does.
    Rows that come by way of many steps should be pinned: they are counted before they are fitted. Packed rows need not be, they know their number.
    """
    ship(train.sparkSession)
    sizes = pin(_sizes(train, predictors, group))
    cores, groups = train.sparkSession.sparkContext.defaultParallelism, max(sizes.count(), 1)
    slices = max(1, min(slices, -(-_GROUPS_PER_CORE * cores // groups)))
    # rounds take long and rows are few bytes, so tasks are counted by groups; by their bytes they would be too few
    tasks = max(min(groups * slices, _GROUPS_PER_TASK * cores), -(-groups * slices // _GROUPS_PER_TASK))
    todo = pin(units(sizes, params, grid, parts).join(sizes, "group_id").withColumn("_fit", F.expr(fit_if)))
    large = sizes.where(F.col("n") > LOCAL_ROWS).select("group_id")
    here = todo.where(F.col("_fit") & (F.col("n") <= LOCAL_ROWS)).withColumn("_slice", F.pmod("part", F.lit(slices))).drop("_fit")
    rows, any_large = _rows(train, predictors, group), not large.isEmpty()
    near = rows.join(large, "group_id", "left_anti") if any_large else rows
    near = near.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))) if slices > 1 else F.lit(0))
    near, here = (d.repartition(tasks, "group_id", "_slice") for d in (near, here))
    out = near.groupBy("group_id", "_slice").cogroup(here.groupBy("group_id", "_slice")).applyInArrow(_in_task(method, bins, holdout), STATE)
    if any_large:
        far = (unpacked(train, predictors).withColumn("_group", F.col(group).cast("bigint")).join(large.withColumnRenamed("group_id", "_group"), "_group", "left_semi").drop("_group"))
        far = pin(stratified_holdout(far, *holdout) if holdout else far)
        open_units = todo.where(F.col("_fit") & (F.col("n") > LOCAL_ROWS)).select("group_id", "part", "param")
        state = pin(begin(open_units, describe(far, bins, predictors, group), method))
        blocks = sizes.where(F.col("n") > LOCAL_ROWS).agg(F.sum(F.ceil(F.col("n") / BLOCK_ROWS))).first()[0]
        out = out.unionByName(_by_rounds(pin(pack(far, predictors, group, max(2 * cores, -(-blocks // _BLOCKS_PER_TASK)))), state, method))
    left_out = todo.where(~F.col("_fit")).selectExpr(
        "group_id", "part", "param", "cast(null as binary) state", "true done", "0 rounds", "0.0D seconds", "cast(null as string) message")
    return out.unionByName(left_out), sizes


def held_out(block: Block, group: int, share: float, seed: int) -> np.ndarray:
    """Marks of ``sampling.stratified_holdout`` for the rows of one group, which need not be ranked by a shuffle."""
    digests = b"".join(hashlib.md5(f"{seed}:{group}:{k}".encode()).digest() for k in block.key.tolist())
    first, second = np.frombuffer(digests, ">u8").reshape(-1, 2).T
    out = np.zeros(len(block.key))
    strata = [np.flatnonzero(block.y == v) for v in np.unique(block.y)]
    if sum(len(rows) >= 2 and block.y[rows[0]] in (0, 1) for rows in strata) == 2:
        for rows in strata:
            order = np.lexsort((block.key[rows], second[rows], first[rows]))
            out[rows[order[:math.ceil(len(rows) * share)]]] = 1
    return out


def _in_task(method: Method, bins: int, holdout: tuple[float, int] | None) -> Callable:
    """All rounds of the units of one group of at most ``LOCAL_ROWS`` rows."""
    fields = pa.schema([("group_id", pa.int64()), ("part", pa.int32()), ("param", pa.float64()), ("state", pa.binary()), ("done", pa.bool_()),
                        ("rounds", pa.int32()), ("seconds", pa.float64()), ("message", pa.string())])

    def run(rows: pa.Table, units: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and units.num_rows:
            held = _block_of(rows)
            known = _described(held.x, bins)
            if holdout:
                held.held = held_out(held, rows.column("group_id")[0].as_py(), *holdout)
            for u in units.to_pylist():
                t0, rounds, done, message = time.perf_counter(), 0, False, None
                held.memo = {}
                state = method.begin(u | known)
                try:
                    while not done and rounds < MOST_ROUNDS:
                        rounds += 1
                        state, done = method.solve(state, method.step(state, held), rounds)
                except (ArithmeticError, ValueError, np.linalg.LinAlgError) as e:
                    # one unit that cannot be fitted must not end the others
                    message = f"{type(e).__name__}: {e}"
                out.append({"group_id": u["group_id"], "part": u["part"], "param": u["param"], "state": _keep(state), "done": True,
                            "rounds": rounds, "seconds": time.perf_counter() - t0, "message": message})
        return pa.Table.from_pylist(out, fields)

    return run


def over_rows(train: DataFrame, model: DataFrame, each: Callable[[Block, dict], Iterator[pd.DataFrame]], schema: str,
              predictors: str = "predictors", group: str = "species_id") -> DataFrame:
    """What ``each`` makes of the rows of a group and its row of ``model`` (species_id, ...); a large group comes in several slices."""
    ship(train.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]
    n = F.sum("n") if is_packed(train) else F.count("*")
    sizes = train.groupBy(F.col(group).cast("bigint").alias("group_id")).agg(F.ceil(n / SLICE_ROWS).cast("int").alias("_slices"))
    known = pin(model.withColumnRenamed("species_id", "group_id").join(sizes, "group_id"))
    many = known.where("_slices > 1").select("group_id", "_slices")
    if many.isEmpty():  # then no row need meet the sizes
        rows = _rows(train, predictors, group).withColumn("_slice", F.lit(0))
    else:
        rows = _rows(unpacked(train, predictors), predictors, group).join(many, "group_id", "left").withColumn(
            "_slice", F.coalesce(F.pmod(F.xxhash64("k", F.lit(11)), F.col("_slices")).cast("int"), F.lit(0))).drop("_slices")
    per_slice = known.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        frames = list(each(_block_of(rows), found.to_pylist()[0])) if rows.num_rows and found.num_rows else []
        return pa.Table.from_pandas(pd.concat(frames)[names], preserve_index=False) if frames else nothing

    nothing = pa.schema([(n, _ARROW[part.split()[1]]) for n, part in zip(names, schema.split(", "))]).empty_table()
    return rows.groupBy("group_id", "_slice").cogroup(per_slice.groupBy("group_id", "_slice")).applyInArrow(run, schema)


def _by_rounds(packed: DataFrame, state: DataFrame, method: Method) -> DataFrame:
    """One Spark pass per round over the blocks of large groups."""
    columns = ["group_id", "block", "n", "p", "key", "x", "y", "w", "held", "labels"]
    moved, sums = f"{BLOCK}, part int, carried array<double>, sums binary, took double", "group_id bigint, part int, sums binary, took double"

    def each(batch: pd.DataFrame) -> Iterator[tuple]:
        for r in batch.itertuples(index=False):
            t0, block = time.perf_counter(), _block(r)
            if method.carries and r.carried is not None:
                method.resume(block, np.asarray(r.carried, float))
            total = method.step(opened(r.state), block)
            yield r, block, total, time.perf_counter() - t0

    def with_carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*(getattr(r, c) for c in columns), r.part, method.carry(b), s.tobytes(), took) for r, b, s, took in each(batch)]
            yield pd.DataFrame(rows, columns=[*columns, "part", "carried", "sums", "took"])

    def merged(found: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        kept: dict[tuple, list] = {}
        for unit, total, took in found:
            old = kept.get(unit)
            kept[unit] = [total, took] if old is None else [old[0] + total, old[1] + took]
            if len(kept) >= HELD_UNITS:
                yield flush(kept)
        if kept:
            yield flush(kept)

    def flush(kept: dict) -> pd.DataFrame:
        rows = [(*unit, v[0].tobytes(), v[1]) for unit, v in kept.items()]
        kept.clear()
        return pd.DataFrame(rows, columns=["group_id", "part", "sums", "took"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from merged(((r.group_id, r.part), s, took) for batch in batches for r, _, s, took in each(batch))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from merged(((r.group_id, r.part), np.frombuffer(r.sums), r.took) for batch in batches for r in batch.itertuples(index=False))

    def combine(parts: pd.DataFrame, unit: pd.DataFrame) -> pd.DataFrame:
        # one row per task that met the unit
        u = unit.iloc[0]
        total, rounds, t0 = sum(np.frombuffer(s) for s in parts["sums"]), int(u["rounds"]) + 1, time.perf_counter()
        now, done, message = opened(u["state"]), True, None
        try:
            now, done = method.solve(now, total, rounds)
        except (ArithmeticError, ValueError, np.linalg.LinAlgError) as e:
            message = f"{type(e).__name__}: {e}"
        seconds = float(u["seconds"]) + float(parts["took"].sum()) + time.perf_counter() - t0
        return pd.DataFrame([(u["group_id"], u["part"], u["param"], _keep(now), bool(done), rounds, seconds, message)],
                            columns=["group_id", "part", "param", "state", "done", "rounds", "seconds", "message"])

    keys = ["group_id", "part"] if method.carries else ["group_id"]
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(state=[_keep(method.needed(opened(s))) for s in b["state"]])

    rows = packed
    if method.carries:  # a row per (block, part), so that each part carries its own numbers
        rows = packed.join(state.select("group_id", "part"), "group_id").withColumn("carried", F.lit(None).cast("array<double>"))
    old = None
    for _ in range(MOST_ROUNDS):
        open_units = state.where("not done")
        asked = open_units.select("group_id", "part", "state")
        if type(method).needed is not Method.needed:
            # pinned, so that its size is known and blocks are not shuffled to meet it
            asked = pin(asked.mapInPandas(ask, "group_id bigint, part int, state binary"))
        met = rows.join(asked, keys)
        if method.carries:
            written = pin(met.mapInPandas(with_carried, moved))
            parts, rows = written.select("group_id", "part", "sums", "took").mapInPandas(add, sums), written.drop("sums", "took")
        else:
            parts = met.mapInPandas(partial, sums)
        stepped = parts.groupBy("group_id", "part").cogroup(open_units.groupBy("group_id", "part")).applyInPandas(combine, STATE)
        before, state = state, pin(stepped.unionByName(state.where("done")))
        drop(before, asked)
        if method.carries:
            if old is not None:
                drop(old)
            old = written
        if state.where("not done").isEmpty():
            break
    return state


def units(described: DataFrame, params: DataFrame | None = None, grid: Sequence[float] = (), parts: int = 1) -> DataFrame:
    """(group_id, part, param): one value of ``params`` (species_id, param) per group, or every value of ``grid``, each in ``parts`` parts."""
    base = described.select("group_id")
    if grid:
        values = F.posexplode(F.array(*[F.lit(float(v)) for v in grid])).alias("_g", "param")
        base = base.select("group_id", values)
    elif params is not None:
        own = params.select(F.col("species_id").alias("group_id"), F.col("param").cast("double").alias("param"))
        base = base.join(own, "group_id", "left").withColumn("_g", F.lit(0))
    else:
        base = base.withColumns({"_g": F.lit(0), "param": F.lit(None).cast("double")})
    return base.select("group_id", F.explode(F.sequence(F.col("_g") * parts, F.col("_g") * parts + (parts - 1))).alias("part"), "param")


def fit_log(final: DataFrame, described: DataFrame) -> DataFrame:
    """(species_id, param, n_samples, n_presences, n_features, rounds, seconds, status) per species and parameter value."""
    per = final.groupBy("group_id", "param").agg(
        F.max("rounds").alias("rounds"), F.sum("seconds").alias("seconds"), F.max("message").alias("_m"))
    return per.join(described, "group_id").select(
        F.col("group_id").alias("species_id"), "param", F.col("n").alias("n_samples"), F.col("n_pos").alias("n_presences"),
        F.col("p").alias("n_features"), "rounds", "seconds",
        F.when(F.col("n_pos") == 0, "no presences").when(F.col("n_pos") == F.col("n"), "no background")
        .when(F.col("_m").isNotNull(), F.concat(F.lit("failed: "), "_m")).otherwise("ok").alias("status"))


def _frames(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """``rows`` in frames of about ``HELD_BYTES``: a state of many trees is many times larger opened than kept."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += sum(getattr(v, "nbytes", 8) for v in row)
        if held >= HELD_BYTES:
            yield pd.DataFrame(out, columns=names)
            out, held = [], 0
    if out:
        yield pd.DataFrame(out, columns=names)


def models(final: DataFrame, table: Callable[[object], list[tuple]], schema: str) -> DataFrame:
    """(species_id, param, ...): the rows that ``table`` makes of each fitted state; ``schema`` names the rest."""
    names = ["species_id", "param", *[part.split()[0] for part in schema.split(", ")]]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _frames(((r.group_id, r.param, *row) for r in batch.itertuples(index=False) for row in table(opened(r.state))), names)

    return final.where("state is not null and message is null").select("group_id", "param", "state").mapInPandas(
        rows, f"species_id bigint, param double, {schema}")


Predict = Callable[[dict, np.ndarray], np.ndarray]


def score(model: DataFrame, rows: DataFrame, predict: Predict, predictors: str = "predictors", by: Sequence[str] = ()) -> DataFrame:
    """``rows`` (species_id, ..., predictors) with ``probability`` in place of the predictors; species without a model drop out.

    ``predict(fields, x)`` rates a matrix of rows by one model row, whose columns are given
    as Arrow scalars. Columns ``by`` of the model are kept: a row is rated once for each of
    their values. Where the model has a column ``weight``, a species has several rows, and
    the weighted mean of their ratings counts. Rows are packed per species first, so a model
    is joined to blocks and not to single rows.
    """
    keep, names = [c for c in rows.columns if c != predictors], list(by)
    merge = "weight" in model.columns
    sizes = rows.join(model.select("species_id").distinct(), "species_id", "left_semi").groupBy("species_id").agg(
        F.ceil(F.count("*") / BLOCK_ROWS).alias("_blocks"))
    one = F.struct(F.struct(*keep).alias("row"), F.transform(predictors, lambda v: v.cast("double")).alias("x"))
    place = F.pmod(F.xxhash64(*[c for c in keep if c != "species_id"]), F.col("_blocks")).alias("_b")
    packed = rows.join(sizes, "species_id").groupBy("species_id", place).agg(F.collect_list(one).alias("r")).select(
        "species_id", "_b", F.transform("r", lambda r: r["row"]).alias("_rows"), F.flatten(F.transform("r", lambda r: r["x"])).alias("_x"))
    packed = pin(packed) if merge else packed
    met = packed.withColumn("_n", F.size("_rows")).join(model, "species_id")
    passed = ["species_id", "_b", *names, *(["weight"] if merge else ["_rows"])]
    met = met.drop("_rows") if merge else met
    schema = ", ".join(f"`{c}` {met.schema[c].dataType.simpleString()}" for c in passed) + ", _p array<double>"

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [c for c in batch.schema.names if c not in ("_rows", "_x")]
            for i in range(batch.num_rows):
                x = batch.column("_x")[i].values.to_numpy(zero_copy_only=False).reshape(batch.column("_n")[i].as_py(), -1)
                p = predict({c: batch.column(c)[i] for c in fields}, x)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(i, 1) for c in passed], pa.array([np.asarray(p, float)], pa.list_(pa.float64()))], [*passed, "_p"])

    ship(rows.sparkSession)
    rated = met.mapInArrow(rate, schema)
    if merge:
        # as many as a model has parts
        parts = rated.groupBy("species_id", "_b", *names).agg(F.collect_list(F.struct("weight", "_p")).alias("_s"), F.sum("weight").alias("_w"))
        zero = F.array_repeat(F.lit(0.0), F.size(F.get("_s", 0)["_p"]))
        total = F.aggregate("_s", zero, lambda a, s: F.zip_with(a, s["_p"], lambda u, v: u + s["weight"] * v))
        rated = parts.select("species_id", "_b", *names, F.transform(total, lambda v: v / F.col("_w")).alias("_p")).join(packed, ["species_id", "_b"])
    pair = F.explode(F.arrays_zip("_rows", "_p"))
    return rated.select(*names, pair.alias("_r")).select(
        *[F.col(f"_r._rows.{c}").alias(c) for c in keep], *names, F.col("_r._p").alias("probability"))
