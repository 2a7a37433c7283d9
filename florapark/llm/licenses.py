"""Licences of files: notices found by TF-IDF cosine to templates, then inherited from the nearest ancestor directory.

A line, a whole file, or a run of as many words as a template has, wherever lines break,
is matched when the cosine of its TF-IDF vector to the template reaches a threshold.
Templates are notices and full licence texts. Document frequencies of their terms are
counted over all documents. What cannot reach the threshold is left out exactly: by
Cauchy-Schwarz a text without a template's cues has at most the share of the template's
norm that lies on its other terms, so every match holds a cue. A file without a notice takes the licence of the deepest directory above
it that holds a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from florapark.llm import licence_texts
from florapark.llm._store import pin, ship

# fixed values: notices by which licences are known; one licence may have several
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License.",
        licence_texts.APACHE_2,
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        licence_texts.BSD_3,
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
        licence_texts.GPL_3,
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files",
        licence_texts.MIT,
    ),
    "Proprietary": ("All rights reserved.",),
}
THRESHOLD = 0.7


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^0-9A-Za-z\u0080-\U0010ffff]+", text.lower()) if w]


def _tokens(text: Column) -> Column:
    return F.split(F.lower(text), r"[^0-9A-Za-z\x{80}-\x{10ffff}]+", -1)


class Matcher:
    """TF-IDF vectors of the templates under given document frequencies."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], df: Mapping[str, int], n: int, threshold: float) -> None:
        self.idf = {w: math.log((n + 1) / (c + 1)) + 1 for w, c in df.items()}
        self.rare = math.log(n + 1) + 1
        self.threshold = threshold
        self.vectors = []
        self.sizes: list[int] = []
        self.cues_of: list[frozenset[str]] = []
        for name, texts in sorted(templates.items()):
            for text in texts:
                words = _words(text)
                v = self.vector(words)
                self.vectors.append((name, v))
                self.sizes.append(len(words))
                # without these, the remaining terms hold less than threshold^2 of the squared norm; rare ones first
                left, cues = 1.0, set()
                for w in sorted(v, key=lambda w: (-v[w] ** 2 / (df.get(w, 0) + 1), w)):
                    if left < threshold**2:
                        break
                    cues.add(w)
                    left -= v[w] ** 2
                self.cues_of.append(frozenset(cues))
        self.number = {w: i for i, w in enumerate(sorted({w for _, v in self.vectors for w in v}))}
        # the last place is that of all other words
        self.weight = np.array([*(self.idf.get(w, self.rare) for w in self.number), self.rare])
        self.dense = []
        for _, v in self.vectors:
            d = np.zeros(len(self.weight))
            for w, x in v.items():
                d[self.number[w]] = x
            self.dense.append(d * self.weight)
        self.cues = sorted(frozenset().union(*self.cues_of))

    def vector(self, words: list[str]) -> dict[str, float]:
        v = {w: c * self.idf.get(w, self.rare) for w, c in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    def best(self, words: list[str]) -> tuple[float, str | None]:
        """Highest cosine and its licence; of equals the first by name."""
        if not words:
            return 0.0, None
        v = self.vector(words)
        scored = [(sum(x * b.get(w, 0.0) for w, x in a.items()), name)
                  for name, t in self.vectors for a, b in ((t, v) if len(t) < len(v) else (v, t),)]
        top = max(s for s, _ in scored)
        return top, min(name for s, name in scored if s == top)

    def windows(self, words: list[str]) -> list[tuple[float, str, int, int]]:
        """(cosine, licence, first word, end) of runs as long as a template that reach the threshold; per template the best of those that overlap.

        A window's norm is at least the root of its words' summed squared idf, so most
        windows are ruled out by running sums; the others are scored exactly.
        """
        out: list[tuple[float, str, int, int]] = []
        here = set(words)
        ids = square = None
        for (name, _), size, cues, dense in zip(self.vectors, self.sizes, self.cues_of, self.dense):
            if size >= len(words) or here.isdisjoint(cues):
                continue
            if ids is None:
                ids = np.array([self.number.get(w, len(self.number)) for w in words])
                square = np.r_[0.0, np.cumsum(self.weight[ids] ** 2)]
            dot = np.r_[0.0, np.cumsum(dense[ids])]
            dot = dot[size:] - dot[:-size]
            open_ = np.flatnonzero(dot >= self.threshold * np.sqrt(square[size:] - square[:-size]) * (1 - 1e-9))
            found = []
            counts: Counter = Counter()
            norm, at = 0.0, -size
            for s in open_.tolist():
                if s >= at + size:
                    counts, norm, at = Counter(), 0.0, s
                    coming, leaving = words[s:s + size], []
                else:
                    coming, leaving, at = words[at + size:s + size], words[at:s], s
                for some, step in ((coming, 1), (leaving, -1)):
                    for w in some:
                        c = counts[w]
                        counts[w] = c + step
                        norm += self.idf.get(w, self.rare) ** 2 * (2 * c * step + 1)
                if (score := dot[s] / math.sqrt(norm)) >= self.threshold:
                    found.append((float(score), s))
            taken: list[int] = []
            for score, s in sorted(found, key=lambda x: (-x[0], x[1])):
                if all(abs(s - o) >= size for o in taken):
                    taken.append(s)
                    out.append((score, name, s, s + size))
        return out


def fit(docs: DataFrame, text: str = "text", templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
        threshold: float = THRESHOLD) -> Matcher:
    """Count the documents that hold each term of the templates, over all of ``docs``."""
    vocabulary = sorted({w for texts in templates.values() for t in texts for w in _words(t)})
    listed = F.split(F.lit(" ".join(vocabulary)), " ")
    held = docs.select(F.array_intersect(_tokens(F.coalesce(F.col(text), F.lit(""))), listed).alias("w"))
    # one row per term of the templates
    df = {r["w"]: r["n"] for r in held.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return Matcher(templates, {w: df.get(w, 0) for w in vocabulary}, docs.count(), threshold)


def notices(docs: DataFrame, matcher: Matcher, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, license, score, covered) of each row with a notice: the best one, and the share of the text's words in notices.

    Lines are split at line feeds; runs of words as long as a template go over them. Null
    and empty texts have no notice. Of equal scores the first licence by name is taken.
    """
    ship(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    cues = F.split(F.lit(" ".join(matcher.cues)), " ")
    some = docs.where(F.arrays_overlap(_tokens(t), cues)).select(F.col(key).alias("_key"), t.alias("_text"))
    known = docs.sparkSession.sparkContext.broadcast(matcher)  # the templates' vectors, whatever the corpus

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        cue = frozenset(m.cues)
        for batch in batches:
            rows = []
            for whole in batch.column("_text").to_pylist():
                found, words, inside = [], [], []
                for line in whole.split("\n"):
                    w = _words(line)
                    if not cue.isdisjoint(w):
                        score, name = m.best(w)
                        if score >= m.threshold:
                            found.append((-score, name))
                            inside.append((len(words), len(words) + len(w)))
                    words += w
                score, name = m.best(words)
                if score >= m.threshold:
                    found.append((-score, name))
                    inside.append((0, len(words)))
                for score, name, start, end in m.windows(words):
                    found.append((-score, name))
                    inside.append((start, end))
                mark = np.zeros(len(words), bool)
                for start, end in inside:
                    mark[start:end] = True
                score, name = min(found, default=(0.0, None))
                rows.append((name, min(1.0, -score), float(mark.sum()) / max(len(words), 1)))
            keep = pa.array([r[0] is not None for r in rows], pa.bool_())
            out = [batch.column("_key"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                   pa.array([r[2] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in out], [key, "license", "score", "covered"])

    kind = docs.schema[key].dataType.simpleString()
    return some.mapInArrow(match, f"`{key}` {kind}, license string, score double, covered double")


def _folder(path: Column) -> Column:
    """Path without its last part; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(files: DataFrame, found: DataFrame, key: str = "doc_id", least_cover: float = 0.5) -> DataFrame:
    """(key, path, license, score, how, license_path) for each row of ``files`` (key, path).

    ``found`` has the notices per key. `own`: a notice in the file itself. `inherited`: from
    the licence file in the deepest directory above it or its own directory. `none`
    otherwise. A licence file is one named LICENSE, LICENCE or COPYING, whatever its case
    and ending, with a notice, or any file whose notices cover ``least_cover`` of its words;
    of several in a directory the best score counts, then the first path. Null paths
    inherit nothing. Directories are resolved first, so a directory with very many files
    is joined once per file and nothing is grouped by it.
    """
    named = files.join(found.groupBy(key).agg(F.max_by(F.struct("license", "score", "covered"), F.struct("score", "license")).alias("f"))
                       .select(key, "f.*"), key, "left")
    named = pin(named.withColumn("_dir", _folder(F.col("path"))))
    is_file = F.lower(F.col("path")).rlike(r"(^|/)(licen[sc]e|copying)[^/]*$") | (F.col("covered") >= least_cover)
    grants = named.where(F.col("license").isNotNull() & is_file & F.col("path").isNotNull()).groupBy("_dir").agg(
        F.min_by(F.struct("license", "path"), F.struct(-F.col("score"), "path")).alias("g"))
    folders = named.where(F.col("path").isNotNull()).select("_dir").distinct()
    parts = F.split("_dir", "/")
    ups = folders.select("_dir", F.explode(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))).alias("up")).distinct()
    nearest = ups.join(grants.withColumnRenamed("_dir", "up"), "up").groupBy("_dir").agg(
        F.max_by("g", F.length("up")).alias("g"))
    out = named.join(nearest, "_dir", "left")
    own = F.col("license").isNotNull()
    return out.select(
        key, "path", F.when(own, F.col("license")).otherwise(F.col("g.license")).alias("license"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(own, "own").when(F.col("g").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(own, F.col("path")).otherwise(F.col("g.path")).alias("license_path"))


def paths(doc_id: Column) -> Column:
    """Paths for a flat table: directories of 20, 500 and 5,000 ids, each with one licence file."""
    top = F.concat(F.lit("r"), F.floor(doc_id / 5000).cast("string"))
    mid = F.concat(top, F.lit("/p"), F.floor(doc_id / 500).cast("string"))
    low = F.concat(mid, F.lit("/d"), F.floor(doc_id / 20).cast("string"))
    return (F.when(F.pmod(doc_id, F.lit(20)) == 0, F.concat(low, F.lit("/LICENSE")))
            .when(F.pmod(doc_id, F.lit(500)) == 10, F.concat(mid, F.lit("/LICENSE")))
            .when(F.pmod(doc_id, F.lit(5000)) == 30, F.concat(top, F.lit("/LICENSE")))
            .otherwise(F.concat(low, F.lit("/"), doc_id.cast("string"), F.lit(".txt"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or that of the nearest directory above it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = pin(notices(docs, fit(docs)))
    return inherit(docs.select("doc_id", paths(F.col("doc_id")).alias("path")), found)
