"""Rates per document that bring domain totals to target weights, with soft domain membership.

A classifier learned from a labelled table gives every document a posterior over
domains. Nonnegative rates then minimise the squared gaps between the expected domain
tokens (rate times tokens times posterior, summed over all documents) and the
targets, by accelerated projected gradient steps that start from rate 1. A step needs
one number per domain from the whole corpus; a document's rate follows from its
posterior and the gradients so far, so no state per document is stored or sent.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from florapark.llm._bytes import NOT_WORD, SPACE, chunks, row_of, word_hashes, word_spans
from florapark.llm._store import few, pin, sample_per_class, ship, unit_hash

BITS = 16
_CLASS = np.zeros(256, np.uint8)  # shape of a text: shares of these kinds of bytes
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = (
        0 if _c >= 128 else 1 if _ch.islower() else 2 if _ch.isupper() else 3 if _ch.isdigit()
        else 4 if _ch in "#*$%&|<>" else 5 if _ch == "!" else 6 if _ch == "\n" else 7 if SPACE[_c] else 8)
_DENSE = 11  # nine shares, the share of distinct words, a constant


def bag(part: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot) of each distinct word of a text, dense features per text, white-space words per text."""
    data = np.frombuffer(part, np.uint8)
    n = len(offsets) - 1
    starts, ends = word_spans(data, NOT_WORD)
    rows = row_of(starts, offsets)
    slots = word_hashes(data, starts, ends) >> np.uint64(64 - BITS)
    pairs = np.unique((rows.astype(np.uint64) << np.uint64(BITS)) | slots)
    row, slot = (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)
    kinds = _CLASS[data]
    cuts = np.minimum(offsets[:-1], len(data) - 1)
    size = np.maximum(offsets[1:] - offsets[:-1] - 1, 1)
    dense = np.zeros((n, _DENSE), np.float32)
    for k in range(9):
        dense[:, k] = np.sqrt(np.maximum(np.add.reduceat((kinds == k).astype(np.int32), cuts) - (k == 6), 0) / size)
    words = np.bincount(rows, minlength=n)
    dense[:, 9] = np.bincount(row, minlength=n) / np.maximum(words, 1)
    dense[:, 10] = 1
    plain = word_spans(data)[0]
    return row, slot, dense, np.bincount(row_of(plain, offsets), minlength=n)


@dataclass
class DomainModel:
    """Multinomial logistic weights per word slot and dense feature; ``shift`` restores the domains' true shares."""

    domains: list[str]
    word: np.ndarray
    dense: np.ndarray
    shift: np.ndarray

    def posterior(self, row, slot, dense) -> np.ndarray:
        n = len(dense)
        logits = dense @ self.dense + self.shift
        for k in range(len(self.domains)):
            logits[:, k] += np.bincount(row, weights=self.word[slot, k], minlength=n)
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _fit_shard(domains: list[str], start: tuple | None, seed: int, frames, least_docs: int, passes: int):
    rows = sorted((int(i), t, y) for f in frames for i, t, y in zip(f["key"], f["text"], f["label"]))
    if not rows:
        return None
    k = len(domains)
    y = np.array([domains.index(x) for _, _, x in rows])
    at, slots, dense = [], [], []
    for first, _, part, offsets in chunks(pa.array([t for _, t, _ in rows], pa.string())):
        r, s, d, _ = bag(part, offsets)
        at.append(r + first), slots.append(s), dense.append(d)
    at, slots, dense = np.concatenate(at), np.concatenate(slots), np.concatenate(dense)
    common = np.bincount(slots, minlength=1 << BITS) >= least_docs
    at, slots = at[common[slots]], slots[common[slots]]
    cut = np.searchsorted(at, np.arange(len(rows) + 1))
    word, flat = start if start else (np.zeros((1 << BITS, k), np.float32), np.zeros((_DENSE, k), np.float32))
    word, flat = word.copy(), flat.copy()
    s_word, s_flat = np.full_like(word, 1e-2), np.full_like(flat, 1e-2)
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(passes):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), 32):
            some = order[low:low + 32]
            n = cut[some + 1] - cut[some]
            pick = np.repeat(cut[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            owner, slot = np.repeat(np.arange(len(some)), n), slots[pick]
            p = DomainModel(domains, word, flat, np.zeros(k)).posterior(owner, slot, dense[some])
            error = np.eye(k)[y[some]] - p
            used, where = np.unique(slot, return_inverse=True)
            g = np.stack([np.bincount(where, weights=error[owner, j], minlength=len(used)) for j in range(k)], 1) / len(some)
            g = (g - 1e-4 * word[used]).astype(np.float32)
            s_word[used] += g * g
            word[used] += 0.1 * g / np.sqrt(s_word[used])
            h = (dense[some].T @ error / len(some)).astype(np.float32)
            s_flat += h * h
            flat += 0.2 * h / np.sqrt(s_flat)
    return word, flat


def fit_domains(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "domain",
                per_domain: int = 3000, rounds: int = 2, shards: int = 4, least_docs: int = 4, seed: int = 5) -> DomainModel:
    """Learn domains from a labelled table (key, label); reads about ``per_domain`` documents of each domain.

    Shards learn apart and their weights are averaged. Rows without label, key or text
    teach nothing. Shares of the domains are counted over all labelled rows.
    """
    spark = docs.sparkSession
    ship(spark)
    # of several labels of one key the smallest counts
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(label).alias("label"))
    drawn, counts = sample_per_class(known, "label", F.col("key"), per_domain, seed)
    domains = sorted(counts)
    if not domains:
        return DomainModel(["all"], np.zeros((1 << BITS, 1), np.float32), np.zeros((_DENSE, 1), np.float32), np.zeros(1))
    sample = pin(docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
                 .join(few(drawn), "key").repartition(shards, F.xxhash64("key")))
    start = None
    for r in range(rounds):

        def train(frames, start=start, r=r):
            import pandas as pd

            if (found := _fit_shard(domains, start, seed + r, frames, least_docs, 3)) is not None:
                yield pd.DataFrame({"word": [found[0].tobytes()], "flat": [found[1].tobytes()]})

        # one row of fixed size per shard
        parts = sample.coalesce(shards).mapInPandas(train, "word binary, flat binary").collect()
        if parts:
            start = tuple(np.mean([np.frombuffer(p[c], np.float32).reshape(-1, len(domains)) for p in parts], axis=0)
                          for c in ("word", "flat"))
    drawn_n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    word, flat = start if start else (np.zeros((1 << BITS, len(domains)), np.float32), np.zeros((_DENSE, len(domains)), np.float32))
    shift = np.array([np.log(max(counts[d], 1) / max(drawn_n.get(d, 0), 1)) for d in domains])
    return DomainModel(domains, word, flat, shift - shift.mean())


def posteriors(docs: DataFrame, model: DomainModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, tokens, posterior) of each row: white-space words, and one probability per domain.

    Null and empty texts have 0 tokens and the posterior of a text without words.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = spark.sparkContext.broadcast(model)  # slots times domains, whatever the corpus

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, n = [], []
            for _, _, part, offsets in chunks(batch.column("_text")):
                row, slot, dense, words = bag(part, offsets)
                p.append(kept.value.posterior(row, slot, dense)), n.append(words)
            width = len(kept.value.domains)
            flat = np.concatenate(p).ravel() if p else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(np.concatenate(n) if n else [], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), pa.array(flat))],
                [key, "tokens", "posterior"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        apply, f"`{key}` {kind}, tokens long, posterior array<double>")


def _rates(p: np.ndarray, steps: list[np.ndarray], momentum: list[float], most: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(rate, extrapolated point) after the given gradient steps, for posteriors ``p``."""
    rate = np.ones(len(p))
    point = rate
    for step, beta in zip(steps, momentum):
        new = np.clip(point - p @ step, 0, most)
        point, rate = new + beta * (new - rate), new
    return rate, point


def fit_rates(weighed: DataFrame, targets: list[float], most: float | None = None, rounds: int = 120,
              close: float = 1e-3) -> tuple[list[np.ndarray], list[float], list[float]]:
    """(steps, momenta, reached totals) over ``weighed`` (tokens, posterior) for target tokens per domain.

    Ends when every domain is within ``close`` of its target, measured on all target
    tokens, when the steps no longer move, or after ``rounds`` passes.
    """
    goal = np.array(targets, float)
    scale = max(goal.sum(), 1.0)
    width = len(goal)
    steps, momentum, t = [], [], 1.0

    def totals(steps, momentum):
        def add(frames):
            import pandas as pd

            at_rate, at_point, mass = np.zeros(width), np.zeros(width), 0.0
            for f in frames:
                if not len(f):
                    continue
                p, n = np.stack(f["posterior"].to_numpy()), f["tokens"].to_numpy(float)
                rate, point = _rates(p, steps, momentum, most)
                at_rate += (n * rate) @ p
                at_point += (n * point) @ p
                mass += float(n @ (p * p).sum(1))
            yield pd.DataFrame([{**{f"r{k}": at_rate[k] for k in range(width)}, **{f"p{k}": at_point[k] for k in range(width)},
                                 "mass": mass}])

        names = [f"r{k}" for k in range(width)] + [f"p{k}" for k in range(width)] + ["mass"]
        row = weighed.mapInPandas(add, ", ".join(f"{c} double" for c in names)).agg(
            *[F.sum(c).alias(c) for c in names]).first()
        x = np.array([row[c] or 0.0 for c in names])
        return x[:width], x[width:-1], x[-1]

    reached, point, mass = totals(steps, momentum)
    rate_of_step = scale / max(mass, 1.0)  # at least the inverse of the largest curvature
    for _ in range(rounds):
        gap = (point - goal) / scale
        if np.abs(reached - goal).max() <= close * scale:
            break
        steps = [*steps, gap * rate_of_step]
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = [*momentum, (t - 1) / t_next]
        t = t_next
        before = reached
        reached, point, _ = totals(steps, momentum)
        if np.abs(reached - before).max() <= close * scale / 100 and len(steps) > 5:
            break
    return steps, momentum, reached.tolist()


def with_rates(weighed: DataFrame, steps, momentum, most: float | None, key: str = "doc_id") -> DataFrame:
    """``weighed`` with ``rate``."""
    def add(frames):
        for f in frames:
            p = np.stack(f["posterior"].to_numpy()) if len(f) else np.zeros((0, 1))
            yield f.assign(rate=_rates(p, steps, momentum, most)[0] if len(f) else [])

    kind = weighed.schema[key].dataType.simpleString()
    return weighed.select(key, "tokens", "posterior").mapInPandas(
        add, f"`{key}` {kind}, tokens long, posterior array<double>, rate double")


def mix(docs: DataFrame, model: DomainModel, weights: Mapping[str, float], total: float | None = None,
        most: float | None = None, whole: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens, posterior, rate, copies) for each row of ``docs``.

    ``weights`` are the wanted shares of the domains (missing: 0); ``total`` the wanted
    tokens, by default those of ``docs``; with ``whole`` that domain is wanted with all
    its expected tokens and sets the total. ``most`` bounds the rates. ``copies`` is the
    rate, rounded up or down by a draw on the key, so that it is met in expectation.
    Empty tables give empty results; other columns are not read.
    """
    weighed = pin(posteriors(docs, model, text, key))
    share = np.array([weights.get(d, 0.0) for d in model.domains], float)
    share = share / share.sum() if share.sum() > 0 else np.full(len(share), 1 / len(share))
    there = weighed.agg(*[F.sum(F.col("tokens") * F.get("posterior", F.lit(k))).alias(f"e{k}") for k in range(len(share))],
                        F.sum("tokens").alias("all")).first()
    if whole is not None and whole in model.domains and share[model.domains.index(whole)] > 0:
        k = model.domains.index(whole)
        total = (there[f"e{k}"] or 0.0) / share[k]
    total = float(there["all"] or 0) if total is None else float(total)
    steps, momentum, _ = fit_rates(weighed, (share * total).tolist(), most)
    rated = with_rates(weighed, steps, momentum, most, key)
    draw = unit_hash(F.col(key), seed=6)
    return rated.withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))


# shares of tokens wanted of each domain
WEIGHTS = {"clean": 0.90, "low": 0.06, "toxic": 0.04}


def domain_of(quality: Column, toxic: Column) -> Column:
    """Domain of a labelled row; null where it has neither label."""
    return (F.when(toxic == 1, "toxic").when(quality == 0, "low")
            .when((quality == 1) | (toxic == 0), "clean"))


def _model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DomainModel:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit_domains(docs, labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, domain posteriors, rate and whole copies of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = _model(spark, docs, sf_dir)
    out = mix(docs, model, WEIGHTS)
    shares = [F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(model.domains)]
    return out.select("doc_id", "tokens", *shares, "rate", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thin out the domains that are above their share; the clean domain stays whole, so no rate exceeds 1.

    Rows go, not ids: a row is known by its doc_id and text, so only rows equal in both share a draw.
    """
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    text, doc_id = F.col(names["text"]), F.col(names["doc_id"])
    key = F.concat_ws(":", doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    rows = docs.withColumnsRenamed(names).withColumn("key", key)
    out = mix(rows.select(F.col("key").alias("doc_id"), text.alias("text")), _model(spark, docs, sf_dir), WEIGHTS, most=1.0, whole="clean")
    gone = out.where("copies = 0").select(F.col("doc_id").alias("key")).distinct()
    return rows.join(gone, "key", "left_anti").select(*[F.col(new).alias(c) for c, new in names.items()])
