"""Language of each document from word labels of a linear-chain conditional random field.

Every word gets a score per language from hashed byte n-grams inside it (those that
touch a word boundary are its affixes) and from the word itself (a learned lexicon).
Learned transitions tie neighbouring words; forward-backward gives each word its
posterior. Training sequences are cut and mixed from several documents, so the
transitions learn how long a stretch of one language is in code-switched text.

A chain runs over at most ``CHAIN`` words; longer texts are several chains, all of
which count. The fit reads a bounded sample (``per_lang`` documents of each
language); everything else covers all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from florapark.llm._bytes import SPACE, chunks, mix, row_of, word_hashes, word_spans
from florapark.llm._store import held_back, pin, sample_per_class, ship

CHAIN = 256
GRAM_BITS, WORD_BITS = 15, 16
_BLANK = 0  # the slot of n-grams that would reach over a word boundary
UNDETERMINED = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[SPACE] = 32


@dataclass
class Crf:
    """``gram`` and ``word``: scores per slot and language; ``move``: transition scores; ``start``: of the first word."""

    langs: list[str]
    gram: np.ndarray
    word: np.ndarray
    move: np.ndarray
    start: np.ndarray

    @classmethod
    def empty(cls, langs: list[str]) -> Crf:
        n = len(langs)
        return cls(langs, np.zeros((1 << GRAM_BITS, n), np.float32), np.zeros((1 << WORD_BITS, n), np.float32),
                   np.zeros((n, n), np.float32), np.zeros(n, np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.gram, self.word, self.move, self.start)])

    @classmethod
    def of(cls, langs: list[str], flat: np.ndarray) -> Crf:
        model, at = cls.empty(langs), 0
        for x in (model.gram, model.word, model.move, model.start):
            x[...] = flat[at:at + x.size].reshape(x.shape)
            at += x.size
        return model


def _features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, slot of the 3-gram and of the 4-gram ending at each byte, slot of each word)."""
    starts, ends = word_spans(data)
    b = _FOLD[data].astype(np.uint32)
    three, four = np.zeros(len(b), np.uint32), np.zeros(len(b), np.uint32)
    three[2:] = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    four[3:] = three[2:-1] << 8 | b[3:]
    shift = np.uint32(32 - GRAM_BITS)
    three = (three * np.uint32(2654435761) ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) >> shift
    four = (four * np.uint32(2246822519) ^ np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE35) >> shift
    gap = SPACE[data]
    lone = np.empty_like(gap)  # a gap after a gap belongs to no word
    lone[0], lone[1:] = gap[0], gap[1:] & gap[:-1]
    for x in (three, four):
        x[lone] = _BLANK
        x[starts] = _BLANK
        x[:2] = _BLANK
    four[starts + 1] = _BLANK
    four[:3] = _BLANK
    slots = (word_hashes(data, starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    return starts, ends, three, four, slots


def _word_scores(model: Crf, starts, three, four, slots) -> np.ndarray:
    """(words, languages)."""
    scores = model.word[slots]
    if len(starts):
        for k in range(scores.shape[1]):
            column = np.ascontiguousarray(model.gram[:, k])
            scores[:, k] += np.add.reduceat(column[three] + column[four], starts)
    return scores


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def forward_backward(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple:
    """Word posteriors and summed pair posteriors of chains.

    ``scores``: (chains, words, languages), chains sorted by falling length; cells
    beyond a chain's length are ignored and get posterior 0.
    """
    n, t, k = scores.shape
    shifted = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(np.float64)
    a, b = np.zeros((n, t, k)), np.zeros((n, t, k))
    weight, first = np.exp(move.astype(np.float64)), np.exp(start.astype(np.float64))
    alive = [int(np.searchsorted(-lengths, -i, "left")) for i in range(t)]  # chains longer than i
    cur = shifted[:, 0] * first
    a[:, 0] = cur / cur.sum(1, keepdims=True)
    for i in range(1, t):
        m = alive[i]
        cur = (a[:m, i - 1] @ weight) * shifted[:m, i]
        a[:m, i] = cur / cur.sum(1, keepdims=True)
    b[np.arange(n), lengths - 1] = 1.0
    for i in range(t - 2, -1, -1):
        m = alive[i + 1]
        cur = (shifted[:m, i + 1] * b[:m, i + 1]) @ weight.T
        b[:m, i] = cur / cur.sum(1, keepdims=True)
    posterior = a * b
    total = posterior.sum(2, keepdims=True)
    posterior = np.divide(posterior, total, out=np.zeros_like(posterior), where=total > 0)
    pairs = np.zeros((k, k))
    for i in range(1, t):
        m = alive[i]
        joint = a[:m, i - 1, :, None] * weight * (shifted[:m, i] * b[:m, i])[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return posterior, pairs


def _chains(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, length) of each chain: runs of one row, cut after ``CHAIN`` words, longest first."""
    edge = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    sizes = np.diff(np.r_[edge, len(rows)])
    parts = -(-sizes // CHAIN)
    first = np.repeat(edge, parts) + CHAIN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    length = np.minimum(CHAIN, np.repeat(edge + sizes, parts) - first)
    order = np.argsort(-length, kind="stable")
    return first[order], length[order]


def _posteriors(model: Crf, scores: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Posterior of each word; chains of similar length go together, so that little is padded."""
    out = np.empty_like(scores)
    first, length = _chains(rows)
    at = 0
    while at < len(first):
        t = int(length[at])
        upto = max(at + 1, int(np.searchsorted(-length, -t // 2, "right")))
        upto = min(upto, at + max(1, (1 << 18) // t))
        cell = first[at:upto, None] + np.arange(t)
        inside = np.arange(t) < length[at:upto, None]
        block = np.where(inside[..., None], scores[np.minimum(cell, len(scores) - 1)], 0)
        out[cell[inside]] = _unary(block, length[at:upto], model)[inside]
        at = upto
    return out


def _unary(scores: np.ndarray, lengths: np.ndarray, model: Crf) -> np.ndarray:
    """As ``forward_backward`` without the pair sums."""
    n, t, k = scores.shape
    shifted = np.exp(scores - scores.max(axis=2, keepdims=True)).transpose(1, 0, 2).copy()
    a = np.zeros((t, n, k), np.float32)
    weight, first = np.exp(model.move), np.exp(model.start)
    alive = [int(np.searchsorted(-lengths, -i, "left")) for i in range(t)]
    cur = shifted[0] * first
    a[0] = cur / cur.sum(1, keepdims=True)
    for i in range(1, t):
        m = alive[i]
        cur = (a[i - 1, :m] @ weight) * shifted[i, :m] + np.float32(1e-30)
        a[i, :m] = cur / cur.sum(1, keepdims=True)
    back = np.ones((n, k), np.float32)
    for i in range(t - 2, -1, -1):
        m = alive[i + 1]
        cur = (shifted[i + 1, :m] * back[:m]) @ weight.T + np.float32(1e-30)
        back[:m] = cur / cur.sum(1, keepdims=True)
        a[i] *= back
        a[i] /= np.maximum(a[i].sum(1, keepdims=True), 1e-30)
    return a.transpose(1, 0, 2)


_LETTER = np.array([chr(c).isalpha() for c in range(128)] + [False] * 128)


def _has_letter(part: bytes, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text of the chunk holds a letter of any script."""
    letter = _LETTER[data]
    upto = np.r_[0, np.cumsum(letter)]
    found = upto[offsets[1:]] > upto[offsets[:-1]]
    for i in np.flatnonzero(~found):  # no ASCII letter: few texts
        text = part[offsets[i]:offsets[i + 1]].decode("utf-8", "ignore")
        found[i] = any(map(str.isalpha, text))
    return found


def label_words(model: Crf, text: str) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of each word of one text."""
    data = np.frombuffer(text.encode() + b"\n", np.uint8)
    starts, ends, three, four, slots = _features(data)
    if not len(starts):
        return []
    post = _posteriors(model, _word_scores(model, starts, three, four, slots), np.zeros(len(starts), np.int64))
    best = post.argmax(1)
    return [(bytes(data[a:b]).decode(), model.langs[k], float(p[k])) for a, b, k, p in zip(starts, ends, best, post)]


def _score_chunk(model: Crf, part: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number or -1, share of it in the word posteriors, words) of each text."""
    data = np.frombuffer(part, np.uint8)
    n = len(offsets) - 1
    lang, share = np.full(n, -1), np.zeros(n)
    starts, _, three, four, slots = _features(data)
    rows = row_of(starts, offsets)
    n_words = np.bincount(rows, minlength=n)
    if len(starts):
        post = _posteriors(model, _word_scores(model, starts, three, four, slots), rows)
        mass = np.stack([np.bincount(rows, weights=post[:, k], minlength=n) for k in range(post.shape[1])], 1)
        has = _has_letter(part, data, offsets)
        lang = np.where(has, mass.argmax(1), -1)
        share = np.where(has, mass.max(1) / np.maximum(mass.sum(1), 1e-9), 0.0)
    return lang, np.clip(share, 0, 1), n_words


@dataclass
class Evidence:
    """Whether a text's words look like a learned language or like letters drawn one by one.

    ``ratio``: log of (share of a byte 3-gram in a language) / (product of the shares of its
    bytes), per slot and language. Shares are drawn towards that product, so a 3-gram that
    was never seen speaks against every language alike, in whatever script. ``unit``: log
    share of each byte. Texts below ``least`` are rejected.
    """

    count: np.ndarray
    unit: np.ndarray
    total: np.ndarray
    least: float = 0.0

    def of(self, part: bytes, offsets: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio per 3-gram of each text, for each word by the language that suits it best; 0 without words."""
        data = np.frombuffer(b"\n" + part, np.uint8)
        starts, _ = word_spans(data)
        out = np.zeros(len(offsets) - 1)
        if not len(starts):
            return out
        slot, folded = _three(data), _FOLD[data]
        chance = np.exp(self.unit[folded].astype(np.float64))
        chance[2:] *= chance[1:-1] * chance[:-2]
        inside = np.ones(len(data))
        inside[starts] = 0  # the first 3-gram of a word ends at its second byte
        gap = SPACE[data]
        inside[1:][gap[1:] & gap[:-1]] = 0
        inside[:2] = 0
        best = np.full(len(starts), -np.inf)
        for k in range(self.count.shape[1]):
            pull = _PULL * self.total[k]
            value = np.log((self.count[slot, k] / chance + pull) / (self.total[k] + pull)) * inside
            np.maximum(best, np.add.reduceat(value, starts), out=best)
        row = row_of(starts - 1, offsets)
        grams = np.bincount(row, weights=np.add.reduceat(inside, starts), minlength=len(out))
        # a few 3-grams are weak evidence
        return np.bincount(row, weights=best, minlength=len(out)) / (grams + 8)


_CHUNK = 1 << 18  # bytes of text that are judged together: a byte takes several hundred in between
_EVIDENCE_BITS = 18
_PULL = 0.02


def _three(data: np.ndarray) -> np.ndarray:
    """Slot of the 3-gram ending at each byte."""
    b = _FOLD[data].astype(np.uint64)
    key = np.zeros(len(b), np.uint64)
    key[2:] = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
    return (mix(key) >> np.uint64(64 - _EVIDENCE_BITS)).astype(np.int64)


_SLICE_SLOTS = 1 << 12  # slots of one row of partial counts


def fit_evidence(learn: DataFrame, check: DataFrame, text: str = "text", label: str = "lang", reject: float = 0.002) -> Evidence | None:
    """Count the 3-grams of every labelled text of ``learn``; None where there is no label.

    A text is rejected when chance explains it better. Where more than ``reject`` of all
    labelled texts of ``check`` would go, the cutoff is lowered to that share. Tasks send
    their counts in slices of fixed size, which are added up slice by slice.
    """
    def usable(docs: DataFrame) -> DataFrame:
        return docs.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(label).alias("label"), F.col(text).alias("text"))

    langs = sorted(r["label"] for r in usable(learn).select("label").distinct().collect())
    if not langs:
        return None
    ship(learn.sparkSession)
    code, width = {y: i for i, y in enumerate(langs)}, len(langs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, unit = np.zeros((1 << _EVIDENCE_BITS) * width, np.int64), np.zeros(256, np.int64)
        for batch in batches:
            known = np.array([code[y] for y in batch.column("label").to_pylist()], np.int64)
            for first, end, part, offsets in chunks(batch.column("text")):
                data = np.frombuffer(b"\n" + part, np.uint8)
                at = _three(data) * width
                at[1:] += np.repeat(known[first:end], np.diff(offsets))
                own = np.ones(len(data), bool)
                own[:2] = False
                own[offsets[:-1] + 1] = False  # 3-grams over the end of a text
                grams += np.bincount(at[own], minlength=len(grams))
                unit += np.bincount(_FOLD[data], minlength=256)
                unit[_FOLD[10]] += end - first - 1  # a line end on either side of each text
        if unit.any():
            cut = np.split(grams, len(grams) // (_SLICE_SLOTS * width))
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(cut)), -1], pa.int32()), pa.array([c.tobytes() for c in (*cut, unit)], pa.binary())],
                                             ["slice", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(batch.column("slice").to_pylist(), batch.column("n").to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n.tobytes() for n in total.values()], pa.binary())], ["slice", "n"])

    kind = "slice int, n binary"
    # a fixed number of rows of fixed size
    found = {r["slice"]: np.frombuffer(r["n"], np.int64) for r in usable(learn).mapInArrow(count, kind).repartition(4, "slice").mapInArrow(add, kind).collect()}
    unit = found.pop(-1) + 1.0
    grams = np.concatenate([found[k] for k in sorted(found)]).reshape(-1, width)
    model = Evidence(grams.astype(np.float32), np.log(unit / unit.sum()).astype(np.float32), np.maximum(grams.sum(0, dtype=np.float64), 1))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [model.of(part, offsets) for _, _, part, offsets in chunks(batch.column("text"), _CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values) if values else np.zeros(0))], ["e"])

    low = usable(check).select("text").mapInArrow(rate, "e double").agg(F.percentile_approx("e", reject, 10_000).alias("q")).first()["q"]
    model.least = min(0.0, low) if low is not None else 0.0
    return model


def _train_shard(langs: list[str], flat: np.ndarray, seed: int, frames: Iterator) -> Crf | None:
    """One pass of AdaGrad over the shard's texts, cut into stretches and mixed into chains of several languages."""
    model = Crf.of(langs, flat)
    rows = sorted((int(i), t, y) for f in frames for i, t, y in zip(f["key"], f["text"], f["label"]))
    if not rows:
        return None
    rng = np.random.Generator(np.random.PCG64(seed))
    part = b"\n".join(t.encode() for _, t, _ in rows) + b"\n"
    offsets = np.r_[0, np.cumsum([len(t.encode()) + 1 for _, t, _ in rows])]
    data = np.frombuffer(part, np.uint8)
    starts, _, three, four, slots = _features(data)
    if not len(starts):
        return None
    labels = np.array([langs.index(y) for _, _, y in rows])[row_of(starts, offsets)]
    doc = row_of(starts, offsets)
    # stretches of 8 to 64 words of one text, in random order, laid end to end and cut into chains
    cuts, at = [], 0
    while at < len(starts):
        upto = min(at + int(rng.integers(8, 65)), int(np.searchsorted(doc, doc[at], "right")))
        cuts.append((at, upto))
        at = upto
    order = np.concatenate([np.arange(*cuts[i]) for i in rng.permutation(len(cuts))])
    chain, per_step = 32, 64
    length = np.r_[starts[1:], len(data)] - starts
    squares = [np.full(x.shape, 1e-2, np.float32) for x in (model.gram, model.word, model.move, model.start)]
    k = len(langs)
    for low in range(0, len(order), chain * per_step):
        words = order[low:low + chain * per_step]
        if len(words) < chain:
            words = order[:chain] if len(order) >= chain else order
        words = words[:len(words) // chain * chain] if len(words) >= chain else words
        t = min(chain, len(words))
        span = length[words]
        byte = np.repeat(starts[words] - (np.cumsum(span) - span), span) + np.arange(span.sum())
        owner = np.repeat(np.arange(len(words)), span)
        x3, x4, xw = three[byte], four[byte], slots[words]
        scores = model.word[xw].astype(np.float64)
        for j in range(k):
            scores[:, j] += np.bincount(owner, weights=model.gram[x3, j] + model.gram[x4, j], minlength=len(words))
        n = len(words) // t
        y = labels[words].reshape(n, t)
        post, pairs = forward_backward(scores.reshape(n, t, k), np.full(n, t), model.move, model.start)
        truth = np.eye(k)[y]
        error = (truth - post).reshape(-1, k)
        seen = np.zeros((k, k))
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        g_gram = np.stack([np.bincount(np.r_[x3, x4], weights=np.r_[error[owner, j], error[owner, j]],
                                       minlength=1 << GRAM_BITS) for j in range(k)], 1)
        g_word = np.stack([np.bincount(xw, weights=error[:, j], minlength=1 << WORD_BITS) for j in range(k)], 1)
        g_gram[_BLANK] = 0
        grads = (g_gram, g_word, seen - pairs, (truth - post)[:, 0].sum(0))
        for x, g, s in zip((model.gram, model.word, model.move, model.start), grads, squares):
            g = (g / n).astype(np.float32)
            s += g * g
            x += 0.1 * g / np.sqrt(s)
    return model


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_lang: int = 400,
        rounds: int = 2, shards: int = 4, seed: int = 7) -> Crf:
    """Learn the field from labelled documents: shards learn apart, their weights are averaged, and so again.

    Reads about ``per_lang`` documents of each language (the documented bound of the
    fit); rows without a label or text teach nothing. Without any row the model knows
    no language.
    """
    spark = docs.sparkSession
    ship(spark)
    usable = docs.where(F.col(label).isNotNull() & (F.length(text) > 0))
    rows, counts = sample_per_class(usable.select(F.col(key).alias("key"), F.col(text).alias("text"),
                                                  F.col(label).alias("label")), "label", F.col("key"), per_lang, seed)
    langs = sorted(counts)
    if not langs:
        return Crf.empty([])
    sample = pin(rows.select(F.coalesce("key", F.xxhash64("text")).cast("long").alias("key"), "text", "label")
                 .repartition(shards, F.xxhash64("key", "text")))
    flat = Crf.empty(langs).flat()
    for r in range(rounds):
        start = flat

        def train(frames, start=start, r=r):
            import pandas as pd

            model = _train_shard(langs, start, seed + r, frames)
            if model is not None:
                yield pd.DataFrame({"w": [model.flat().astype(np.float32).tobytes()]})

        # one row of fixed size per shard
        parts = [np.frombuffer(x["w"], np.float32) for x in
                 sample.coalesce(shards).mapInPandas(train, "w binary").collect()]
        if parts:
            flat = np.mean(parts, axis=0)
    return Crf.of(langs, flat)


def predict(docs: DataFrame, model: Crf, text: str = "text", evidence: Evidence | None = None) -> DataFrame:
    """``docs`` with lang_pred, score (share of the predicted language in the word posteriors) and n_words.

    Null texts and texts without a letter are `und` with score 0. Columns of these
    names in ``docs`` are replaced; all others stay as they are, nulls and repeated
    rows too. With ``evidence``, a column of that name tells how far the words look like a learned language.
    """
    spark = docs.sparkSession
    ship(spark)
    added = {"lang_pred": "string", "score": "double", "n_words": "long"} | ({"evidence": "double"} if evidence else {})
    kept = [c for c in docs.columns if c not in added]
    # slots times languages, whatever the corpus
    flat, looks = spark.sparkContext.broadcast((model.langs, model.flat())), spark.sparkContext.broadcast(evidence)

    def judge(texts: pa.Array) -> pa.Array:
        known = Crf.of(*flat.value)
        names = np.array([*known.langs, UNDETERMINED], dtype=object)
        lang, score, words, clear = [], [], [], []
        for _, _, part, offsets in chunks(texts, _CHUNK):
            if known.langs:
                one, share, n = _score_chunk(known, part, offsets)
            else:
                n = np.zeros(len(offsets) - 1, np.int64)
                one, share = np.full(len(n), -1), np.zeros(len(n))
            lang.append(one), score.append(share), words.append(n)
            if evidence:
                clear.append(looks.value.of(part, offsets))
        flat_lang = np.concatenate(lang) if lang else np.zeros(0, int)
        columns = [pa.array(names[flat_lang].tolist(), pa.string()),
                   pa.array(np.concatenate(score) if score else [], pa.float64()),
                   pa.array(np.concatenate(words) if words else [], pa.int64())]
        if evidence:
            columns.append(pa.array(np.concatenate(clear) if clear else [], pa.float64()))
        return pa.StructArray.from_arrays(columns, list(added))

    # only the texts go to the workers and only the verdicts come back; not to be worked out again above a filter
    judged = F.arrow_udf(judge, ", ".join(f"{c} {kind}" for c, kind in added.items())).asNondeterministic()
    found = docs.select(*[F.col(f"`{c}`") for c in kept], judged(F.col(text)).alias("_found"))
    return found.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"_found.{c}").alias(c) for c in added])


def query(spark, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those whose CRC-32 modulo 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = held_back(F.col("doc_id"), 5, 0)
    model = fit(docs.where(~held))
    out = predict(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those whose words look like chance rather than like any learned language.

    Every word counts for the language that suits it best, so texts of several languages
    stay, however evenly they share the words. Where no row has a label no language is
    learned, and every document stays, also those without a letter.
    """
    held = held_back(F.col("doc_id"), 5, 0)
    model = fit(docs.where(~held))
    if not model.langs:
        return docs
    evidence = fit_evidence(docs.where(~held), docs.where(held))
    judged = predict(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns}), model, "in_text", evidence)
    kept = judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("evidence") >= evidence.least))
    return kept.select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])
