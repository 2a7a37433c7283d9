"""Fill-in-the-middle rewriting: whole texts cut at two token ranks found in an indexable skip list.

A text is a sequence of tokens, ``[A-Za-z]+|[^A-Za-z]``. Its skip list has one node per
token; the height of a node is drawn by hash of its rank, and the first node of a text
stands in every lane. Each lane entry carries two widths up to the next entry of its lane:
tokens (units) and code points. A rank is looked up by descending from the highest lane,
moving right while the units passed do not exceed the rank; the code points passed on the
way are the exact place of the cut. The lists of all texts of a chunk lie in the same
arrays, and all their lookups descend together.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from florapark.llm._bytes import chunks, mix
from florapark.llm._store import ship

MARKS = ("<P>", "<S>", "<M>")
_PROMOTE_BITS = 2  # a node rises to the next lane with chance 1/4
_LANES = 16
_NO_STEP = 1 << 62  # width of the end of a lane: no search steps over it
_LETTER = np.array([chr(c).isalpha() and c < 128 for c in range(256)])
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class SkipList:
    """Indexable skip lists of many token sequences, one after the other.

    ``points`` are the code points of each token, ``first`` the index of the first token
    of each (non-empty) sequence, ascending. ``units[k]`` and ``points[k]`` are the widths
    of the entries of lane k, ``down[k]`` their places in lane k - 1.
    """

    def __init__(self, points: np.ndarray, first: np.ndarray):
        n = len(points)
        length = np.diff(np.append(first, n))
        rank = np.arange(n) - np.repeat(first, length)
        draw = mix(rank.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        head = np.zeros(n, bool)
        head[first] = True
        self.units, self.points, self.down, self.heads = [np.ones(n, np.int64)], [points.astype(np.int64)], [None], [first]
        for k in range(1, _LANES):
            low = np.uint64((1 << (_PROMOTE_BITS * k)) - 1)
            # entries of the lane below that also stand in this one
            up = np.flatnonzero(head | (draw & low == 0))
            if len(up) == len(head):
                break
            self.units.append(np.add.reduceat(self.units[-1], up))
            self.points.append(np.add.reduceat(self.points[-1], up))
            self.down.append(up)
            draw, head = draw[up], head[up]
            self.heads.append(np.flatnonzero(head))
        self.units = [np.append(u, _NO_STEP) for u in self.units]

    def locate(self, sequence: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Code points before token ``rank`` (up to the length) of each numbered ``sequence``."""
        top = len(self.units) - 1
        at = self.heads[top][sequence].copy()
        passed, where = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k in range(top, -1, -1):
            moving = np.arange(len(at))
            while len(moving):
                step = self.units[k][at[moving]]
                moving = moving[passed[moving] + step <= rank[moving]]
                passed[moving] += self.units[k][at[moving]]
                where[moving] += self.points[k][at[moving]]
                at[moving] += 1
            if k:
                # past the last entry the search is over: all units of the sequence are passed
                at = np.append(self.down[k], len(self.units[k - 1]) - 1)[at]
        return where


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of each token, tokens before each text and at the end) of texts joined by a line feed.

    Every code point that is not a letter is a token; so is each run of letters.
    """
    letter = _LETTER[data]
    starts_point = (data & 0xC0) != 0x80
    after_letter = np.zeros(len(data), bool)
    after_letter[1:] = letter[:-1]
    starts = starts_point & ~(letter & after_letter)
    starts[offsets[1:] - 1] = False  # the line feeds between texts are no tokens
    starts_point[offsets[1:] - 1] = False
    at = np.flatnonzero(starts)
    points = np.add.reduceat(starts_point.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    return points, np.searchsorted(at, offsets)


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """The first four 32-bit numbers of the SHA-256 of ``seed:doc_id``; a missing id is empty."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def transform(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``docs`` (doc_id, text).

    ``n`` counts tokens. With h1 to h4 the draws of the doc_id, the prefix ends after the
    smaller of h1 % (n + 1) and h2 % (n + 1) tokens and the middle after the larger.
    ``percent`` of the texts are rewritten, ``spm_percent`` of these with the suffix
    first: psm is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, spm is ``<S>`` suffix
    ``<P>`` prefix ``<M>`` middle. The rest are plain: unchanged, with null lengths. So
    are empty and null texts (both give an empty output) and texts that hold a mark.
    Rows that repeat give equal rows; rows without doc_id share one draw. Very long texts
    are cut as they are. Other columns are not read.
    """
    ship(docs.sparkSession)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, end, part, offsets in chunks(batch.column("text")):
                points, before = tokens(np.frombuffer(part, np.uint8), offsets)
                n = np.diff(before)
                hashed = [draws(seed, i) for i in ids[first:end]]
                texts = [part[a:b - 1].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                cut = np.array([bool(t) and h[2] % 100 < percent and not any(m in t for m in MARKS) for t, h in zip(texts, hashed)], bool)
                a, b = _cuts(points, before, n, hashed, cut)
                form, output, prefix, middle = [], [], [], []
                for t, h, yes, lo, hi in zip(texts, hashed, cut.tolist(), a.tolist(), b.tolist()):
                    if not yes:
                        form.append("plain"), output.append(t), prefix.append(None), middle.append(None)
                        continue
                    head, mid, tail = t[:lo], t[lo:hi], t[hi:]
                    spm = h[3] % 100 < spm_percent
                    form.append("spm" if spm else "psm")
                    output.append(f"<S>{tail}<P>{head}<M>{mid}" if spm else f"<P>{head}<S>{tail}<M>{mid}")
                    prefix.append(lo), middle.append(hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                     pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rewrite, SCHEMA)


def _cuts(points: np.ndarray, before: np.ndarray, n: np.ndarray, hashed: list, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points before the middle and before the suffix of each text to be cut, 0 for the others."""
    lo, hi = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    rows = np.flatnonzero(cut)
    if len(rows):
        filled = np.flatnonzero(n > 0)
        lists = SkipList(points, before[:-1][filled])
        h = np.array([hashed[r][:2] for r in rows], np.int64) % (n[rows, None] + 1)
        sequence = np.searchsorted(filled, rows)
        lo[rows], hi[rows] = lists.locate(sequence, h.min(1)), lists.locate(sequence, h.max(1))
    return lo, hi


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given. A text that was cut holds no mark, so the marks part the output in one way."""
    part = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == "psm", F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2)))
        .when(form == "spm", F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1))).otherwise(output)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rewritten, with digests of the output and of the text rebuilt from it."""
    out = transform(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
