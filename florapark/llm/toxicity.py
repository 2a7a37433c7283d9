"""Toxic documents and the sentences that make them so, by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from its words and their stems;
the document's is their noisy-or, 1 - product of (1 - p). Only document labels are
needed: the gradient of the noisy-or gives most of the blame to the sentences that
already look worst. The weights learned this way then rank sentences, which locates
the offending ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from florapark.llm._bytes import NOT_WORD, chunks, mix, row_of, word_hashes, word_spans
from florapark.llm._store import few, held_back, pin, sample_per_class, ship

BITS = 18
STEMS = (4, 5, 6)  # bytes of a word's beginning that also count as features, for inflected forms
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True  # line feed ! . ?
THRESHOLD = 0.3
OFFENDING = 0.1  # probability above which a sentence is reported
START_SQUARE = 0.01  # of the adaptive step sizes; larger values favour words seen often
STEP = 0.2
SPARSE = 0.06  # pull of each step towards 0


@dataclass
class BagModel:
    """Weight per slot of words and stems, one bias for all sentences, and a map of the noisy-or's log-odds to probabilities."""

    word: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0


def _sentences(part: bytes, offsets: np.ndarray):
    """(sentence of each feature, its slot, row of each sentence, byte start and end of each sentence)."""
    data = np.frombuffer(part, np.uint8)
    starts, ends = word_spans(data, NOT_WORD)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), starts, ends
    # the texts are joined by line feeds, so no sentence crosses two texts
    number = np.cumsum(_STOP[data])[starts]
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    sentence = np.cumsum(np.r_[False, number[1:] != number[:-1]])
    last = np.r_[first[1:], len(starts)] - 1
    hashes = [word_hashes(data, starts, ends)]
    for k in STEMS:
        stem = word_hashes(data, starts, np.minimum(starts + k, ends))
        hashes.append(mix(stem + np.uint64(k)))
    slots = (np.stack(hashes, 1).ravel() >> np.uint64(64 - BITS)).astype(np.int64)
    sentence = np.repeat(sentence, len(hashes))
    return sentence, slots, row_of(starts[first], offsets), starts[first], ends[last]


def _sentence_logits(model: BagModel, sentence, slots, n) -> np.ndarray:
    return model.bias + np.bincount(sentence, weights=model.word[slots], minlength=n)


def _log_not(logits: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid)."""
    return -np.logaddexp(0.0, logits)


def _document_scores(model: BagModel, log_not: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Calibrated noisy-or of each document from its sentences' log(1 - p)."""
    quiet = np.bincount(rows, weights=log_not, minlength=n)
    odds = np.log(np.maximum(-np.expm1(quiet), 1e-12)) - np.maximum(quiet, -60.0)
    return 1 / (1 + np.exp(-(model.slope * odds + model.shift)))


def _offending(model: BagModel, p: np.ndarray, logits: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Whether each sentence is over the cutoff, or needed among the best for its document to reach the threshold."""
    out = p > OFFENDING
    reached = _document_scores(model, np.where(out, _log_not(logits), 0.0), rows, len(scores))
    short = (scores >= THRESHOLD) & (reached < THRESHOLD)
    some = np.flatnonzero(short[rows])
    some = some[np.lexsort((-p[some], rows[some]))]
    cuts = np.flatnonzero(np.diff(rows[some])) + 1
    for mine in np.split(some, cuts) if len(some) else []:
        # of the best one, the best two and so on
        upto = np.cumsum(_log_not(logits[mine]))
        enough = _document_scores(model, upto, np.arange(len(mine)), len(mine)) >= THRESHOLD
        out[mine[:int(enough.argmax()) + 1 if enough.any() else len(mine)]] = True
    return out


_UPDATES = 400  # steps of 32 documents that a shard takes in a round, whatever its size


def _fit_shard(start: BagModel | None, weight: dict, seed: int, frames, least_docs: int, passes: int, decay: float):
    rows = sorted((int(i), t, int(y)) for f in frames for i, t, y in zip(f["key"], f["text"], f["label"]))
    if not rows:
        return None
    # a small shard is read more often, and asks less of a feature
    passes = max(passes, min(40, -(-_UPDATES * 32 // len(rows))))
    least_docs = max(2, min(least_docs, len(rows) // 200))
    y = np.array([r[2] for r in rows])
    w = np.array([weight[int(v)] for v in y])
    s_doc, s_cut, all_slots, words_of = [], [0], [], []
    for first, _, part, offsets in chunks(pa.array([t for _, t, _ in rows], pa.string())):
        sentence, slots, row, _, _ = _sentences(part, offsets)
        s_doc.append(row + first)
        words_of.append(np.bincount(sentence, minlength=len(row)))
        all_slots.append(slots.astype(np.int32))
    s_doc, words_of, slots = np.concatenate(s_doc), np.concatenate(words_of), np.concatenate(all_slots)
    s_first = np.cumsum(words_of) - words_of
    doc_of_word = np.repeat(s_doc, words_of)
    pairs = np.unique((doc_of_word << BITS) | slots)
    common = np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS) >= least_docs
    d_cut = np.searchsorted(s_doc, np.arange(len(rows) + 1))
    model = BagModel(np.zeros(1 << BITS, np.float32), -5.0) if start is None else BagModel(start.word.copy(), start.bias)
    square, bias_square = np.full(1 << BITS, START_SQUARE, np.float32), 1e-3
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(passes):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), 32):
            some = order[low:low + 32]
            n_s = d_cut[some + 1] - d_cut[some]
            if not n_s.sum():
                continue
            sent = np.repeat(d_cut[some] - (np.cumsum(n_s) - n_s), n_s) + np.arange(n_s.sum())
            owner = np.repeat(np.arange(len(some)), n_s)
            n_w = words_of[sent]
            pick = np.repeat(s_first[sent] - (np.cumsum(n_w) - n_w), n_w) + np.arange(n_w.sum())
            word_owner, slot = np.repeat(np.arange(len(sent)), n_w), slots[pick]
            use = common[slot]
            word_owner, slot = word_owner[use], slot[use]
            logits = _sentence_logits(model, word_owner, slot, len(sent))
            p = 1 / (1 + np.exp(-np.clip(logits, -50, 50)))
            quiet = np.bincount(owner, weights=_log_not(logits), minlength=len(some))
            loud = np.maximum(-np.expm1(quiet), 1e-9)
            # d log-likelihood / d logit: p (1 - P) / P where the document is toxic, -p where it is not
            push = np.where(y[some] == 1, np.exp(quiet) / loud, -1.0) * w[some]
            g_s = np.clip(push[owner] * p, -5, 5)
            used, where = np.unique(slot, return_inverse=True)
            g = (np.bincount(where, weights=g_s[word_owner], minlength=len(used)) - decay * model.word[used]).astype(np.float32)
            square[used] += g * g
            rate = STEP / np.sqrt(square[used])
            moved = model.word[used] + rate * g
            # the pull towards 0 keeps the few words that carry the label and drops the rest
            model.word[used] = np.sign(moved) * np.maximum(np.abs(moved) - rate * SPARSE, 0)
            b = float(g_s.sum())
            bias_square += b * b
            model.bias += 0.2 * b / np.sqrt(bias_square)
    model.word[~common] = 0
    return model


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
        per_class: int = 4000, rounds: int = 2, shards: int = 4, least_docs: int = 8, seed: int = 11) -> BagModel:
    """Learn from document labels (key, label 0/1); reads about ``per_class`` documents of each label.

    Equal texts count once, so copies carry no extra weight. Shards learn apart, the
    average starts the next round. Rows without key, text or label teach nothing; with
    one class only, every score is that class's share.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(
        F.max(label).cast("int").alias("label"))
    hashed = docs.where(F.length(text) > 0).select(F.col(key).alias("key"), F.xxhash64(text).alias("h")).join(known, "key")
    once = pin(hashed.groupBy("h").agg(F.min("key").alias("key"), F.max("label").alias("label")))
    drawn, counts = sample_per_class(once, "label", F.col("h"), per_class, seed)
    total = sum(counts.values())
    if len(counts) < 2:
        share = float(next(iter(counts), 0))
        return BagModel(np.zeros(1 << BITS, np.float32), -5.0, 0.0, 20.0 * (share - 0.5))
    sample = pin(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(few(drawn.select("key", "label")), "key")
                 .repartition(shards, F.xxhash64("key")))
    seen = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    shards = max(1, min(shards, sum(seen.values()) // 1500))
    weight = {k: (counts[k] / total) / max(seen.get(k, 0), 1) * sum(seen.values()) for k in counts}
    model = None
    for r in range(rounds):

        def train(frames, model=model, r=r):
            import pandas as pd

            if (found := _fit_shard(model, weight, seed + r, frames, least_docs, 3, 1e-4)) is not None:
                yield pd.DataFrame({"word": [found.word.tobytes()], "bias": [found.bias]})

        # one row of fixed size per shard
        parts = sample.coalesce(shards).mapInPandas(train, "word binary, bias double").collect()
        model = BagModel(np.mean([np.frombuffer(p["word"], np.float32) for p in parts], axis=0),
                         float(np.mean([p["bias"] for p in parts])))
    return model


def score(docs: DataFrame, model: BagModel, text: str = "text", most_spans: int | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``offending``: array of (start, end, score), the offending sentences.

    Offsets are code points of the first word's start and the last word's end. Every
    sentence above probability ``OFFENDING`` is reported, worst first; where these alone
    do not bring a document of ``THRESHOLD`` or more there, the next best follow until
    they do. ``most_spans`` keeps only so many of the worst. Texts without words, also null, have the
    score of no sentence, near 0. Other columns stay; columns of these names are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in docs.columns if c not in ("score", "offending")]
    known = spark.sparkContext.broadcast(model)  # fixed number of slots, whatever the corpus

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            scores, spans = [], []
            for _, _, part, offsets in chunks(batch.column("_text")):
                n = len(offsets) - 1
                sentence, slots, rows, a, b = _sentences(part, offsets)
                logits = _sentence_logits(m, sentence, slots, len(rows))
                scores.append(_document_scores(m, _log_not(logits), rows, n))
                found: list[list] = [[] for _ in range(n)]
                p = 1 / (1 + np.exp(-np.clip(logits, -50, 50)))
                chars = np.r_[0, np.cumsum((np.frombuffer(part, np.uint8) & 0xC0) != 0x80)]  # code points before each byte
                for i in np.flatnonzero(_offending(m, p, logits, rows, scores[-1])):
                    base = chars[offsets[rows[i]]]
                    found[rows[i]].append((int(chars[a[i]] - base), int(chars[b[i]] - base), float(p[i])))
                found = [sorted(x, key=lambda s: (-s[2], s[0]))[:most_spans] for x in found]
                spans.extend([dict(zip(("start", "end", "score"), s)) for s in x] for x in found)
            names = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(spans, span_type)],
                [*names, "score", "offending"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept]
                       + ["score double", "offending array<struct<start:long,end:long,score:double>>"])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_text")).mapInArrow(apply, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = held_back(F.col("doc_id"), 4, 2)
    model = fit(docs.where(~held), labels.where(~held))
    out = score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")
