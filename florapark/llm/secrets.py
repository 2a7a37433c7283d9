"""Secrets in texts: fixed patterns, and runs of characters that look more random than any identifier.

Two first-order Markov models over characters, one of random strings and one of
ordinary identifiers, are learned from labelled samples; a long run of key
characters is reported when its log-likelihood ratio says random. Only column
expressions are used. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from florapark.llm._store import unit_hash

# fixed values: the base patterns, their kinds in order, and the least length of a finding
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
# a match of 18 or more, or 16 or more, characters is the same as a long enough match of the open pattern
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

RUN = r"[A-Za-z0-9+/_=-]{16,}"
_FIRST, _WIDTH = 43, 80  # code of "+", and so many codes up to "z"
_SCALE = 1000
MARK = "<secret>"


@dataclass(frozen=True)
class SecretModel:
    """Log-likelihood ratio in thousandths for each pair of neighbouring characters, by code."""

    ratio: tuple[int, ...]

    def column(self) -> Column:
        # one text constant, folded to an array once, instead of a literal per entry
        return F.split(F.lit(",".join(map(str, self.ratio))), ",").cast("array<int>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, although ``body`` may name it often."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, join: Callable[[Column, Column], Column], back: bool = False) -> Column:
    """Running total of an array under ``join``, from its end if ``back``.

    Each of log2(n) rounds joins every value with the one 1, 2, 4, ... places before, so no
    array is copied per value. ``join`` must take a null as nothing.
    """
    rounds = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int")))

    def double(acc: Column, k: Column) -> Column:
        far = F.call_function("shiftleft", F.lit(1), k) * (1 if back else -1)
        return F.transform(acc, lambda x, i: join(x, F.get(acc, i + far)))

    return F.when(F.size(values) > 1, F.aggregate(rounds, values, double)).otherwise(values)


def _spans(text: Column, found: Column, parts: Column, kind: int, wanted: Column | None = None) -> Column:
    """Array of (start, kind, end) from the matches of a pattern and the parts between them.

    ``wanted`` flags matches to keep, one per match; the others only move the position.
    """
    size = F.transform(found, F.length)
    step = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), size, lambda p, n: F.length(p) + n)
    ends = _running(step, lambda x, before: x + F.coalesce(before, F.lit(0)))
    spans = F.zip_with(ends, size, lambda e, n: F.struct((e - n).alias("start"), F.lit(kind).alias("kind"), e.alias("end")))
    if wanted is not None:
        spans = F.filter(F.zip_with(spans, wanted, lambda x, k: F.when(k, x)), lambda x: x.isNotNull())
    return spans.cast("array<struct<start:int,kind:int,end:int>>")


def _outside(base: Column, extra: Column) -> Column:
    """All spans of ``base`` and those of ``extra`` that overlap none of them, sorted by start and kind."""

    def free(every: Column) -> Column:
        reach = _running(F.transform(every, lambda x: F.when(x["kind"] < 3, x["end"])), lambda x, y: F.greatest(x, y))
        ahead = _running(F.transform(every, lambda x: F.when(x["kind"] < 3, x["start"])), lambda x, y: F.least(x, y), back=True)
        clear = F.zip_with(every, F.arrays_zip(reach.alias("reach"), ahead.alias("ahead")), lambda x, o: F.when(
            (x["kind"] < 3) | ((F.coalesce(o["reach"], F.lit(0)) <= x["start"]) & (F.coalesce(o["ahead"], x["end"]) >= x["end"])), x))
        return F.filter(clear, lambda x: x.isNotNull())

    return _let(F.sort_array(F.concat(base, extra)), free)


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def _matches(text: Column, pattern: str, kind: int, may: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(may, _spans(text, found, F.split(text, pattern, -1), kind)).otherwise(_none())


def _assignments(text: Column) -> Column:
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    long = F.transform(value, lambda v: F.length(v) >= ASSIGN_VALUE)
    found = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))
    return F.when(text.rlike(ASSIGN), _spans(text, found, F.split(text, ASSIGN, -1), 0, long)).otherwise(_none())


def ratio_of(token: Column, model: SecretModel) -> Column:
    """Log-likelihood ratio, random against ordinary, of the neighbouring characters of a run, in thousandths."""
    table = model.column()
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - _FIRST)
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1),
                       lambda a, b: F.get(table, a * _WIDTH + b).cast("long"))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x, F.lit(0).cast("long")))


def fit(samples: DataFrame, smoothing: float = 0.5) -> SecretModel:
    """Learn both models from ``samples`` (token: string, is_secret: boolean).

    Counts pairs of neighbouring characters of the key alphabet in each class. Null
    tokens or labels and tokens of fewer than two characters teach nothing; without
    any sample every ratio is 0.
    """
    codes = F.transform(F.split("token", ""), lambda c: F.ascii(c) - _FIRST)
    pairs = F.zip_with(F.slice("codes", F.lit(1), F.size("codes") - 1), F.slice("codes", F.lit(2), F.size("codes") - 1),
                       lambda a, b: F.when(a.between(0, _WIDTH - 1) & b.between(0, _WIDTH - 1), a * _WIDTH + b))
    rows = (
        samples.where(F.col("is_secret").isNotNull() & (F.length("token") >= 2))
        .select("is_secret", codes.alias("codes"))
        .select("is_secret", F.explode(pairs).alias("pair")).where(F.col("pair").isNotNull())
        .groupBy("pair").agg(F.count_if("is_secret").alias("s"), F.count_if(~F.col("is_secret")).alias("o"))
        .collect()  # at most the square of the alphabet
    )
    seen = {r["pair"]: (r["s"], r["o"]) for r in rows}
    import math

    out = []
    for a in range(_WIDTH):
        line = [seen.get(a * _WIDTH + b, (0, 0)) for b in range(_WIDTH)]
        s_all, o_all = (sum(x[k] for x in line) + smoothing * _WIDTH for k in (0, 1))
        out += [round(_SCALE * (math.log((s + smoothing) / s_all) - math.log((o + smoothing) / o_all))) for s, o in line]
    return SecretModel(tuple(out))


def weak_samples(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_docs: int = 20_000) -> DataFrame:
    """Labelled samples (token, is_secret) from about ``sample_docs`` documents, the documented bound of the fit.

    Secrets are the values the base patterns find; ordinary identifiers are the words of
    eight or more letters, digits, hyphens and underscores in what the patterns leave.
    """
    total = docs.count()
    some = docs.where(unit_hash(F.col(key), seed=4) < min(1.0, sample_docs / max(1, total)))
    t = F.coalesce(F.col(text), F.lit(""))
    values = F.filter(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_VALUE)
    rest = F.regexp_replace(F.regexp_replace(t, ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    secret = F.concat(values, F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(t, F.lit(HEX), F.lit(0)))
    plain = F.regexp_extract_all(rest, F.lit("[A-Za-z][A-Za-z0-9_-]{7,}"), F.lit(0))
    return (
        some.select(F.explode(secret).alias("token"), F.lit(True).alias("is_secret"))
        .unionByName(some.select(F.explode(plain).alias("token"), F.lit(False).alias("is_secret")))
    )


def find(docs: DataFrame, model: SecretModel, text: str = "text", least_ratio: float = 12.0) -> DataFrame:
    """``docs`` with ``secrets``: array of (start, kind, end), sorted by start and kind number (see ``KINDS``).

    Kinds 0 to 2 are the base patterns, each leftmost and without overlap within its
    kind; kind 3 are runs of 16 or more key characters outside all base findings whose
    log-likelihood ratio reaches ``least_ratio``. Null and empty texts have none. A
    column ``secrets`` of ``docs`` is replaced; all other columns stay.
    """
    # names that the scan itself does not use, and back again at the end
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    t = F.coalesce(F.col("_text"), F.lit(""))
    base = F.concat(
        _assignments(t), _matches(t, ACCESS, 1, t.contains("AKIA")), _matches(t, HEX, 2, t.rlike("[0-9a-f]{16}")))
    runs = F.regexp_extract_all(t, F.lit(RUN), F.lit(0))
    odd = F.transform(runs, lambda r: ~r.rlike("^[0-9a-f]+$") & (ratio_of(r, model) >= round(least_ratio * _SCALE)))
    extra = F.when(t.rlike(RUN), _spans(t, runs, F.split(t, RUN, -1), 3, odd)).otherwise(_none())
    return (
        docs.withColumnsRenamed(names).withColumn("_text", F.col(names[text]))
        .withColumn("_base", base).withColumn("_extra", extra)
        .withColumn("secrets", F.when(F.size("_extra") == 0, F.sort_array("_base"))
                    .otherwise(_outside(F.col("_base"), F.col("_extra"))))
        .select(*[F.col(n).alias(c) for c, n in names.items() if c != "secrets"], "secrets")
    )


def span_text(spans: Column) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = MARK, width: int = 1024) -> Column:
    """``text`` with every stretch covered by spans replaced by ``mark``; ``spans`` sorted by start.

    The text is cut into chunks of ``width`` characters first, so that a stretch is found
    without a walk from the beginning.
    """
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))

    def stretch(chunk: Column, start: Column, end: Column) -> Column:
        """Characters from start to end, which is not before start."""
        i, j = F.floor(start / width).cast("int"), F.floor(end / width).cast("int")
        head, tail = F.get(chunk, i), F.coalesce(F.get(chunk, j), F.lit(""))
        far = F.concat(F.substring(head, start % width + 1, F.lit(width)),
                       F.array_join(F.slice(chunk, i + 2, j - i - 1), ""), F.substring(tail, F.lit(1), end % width))
        near = F.substring(F.coalesce(head, F.lit("")), start % width + 1, end - start)
        return F.when(i == j, near).otherwise(far)

    def pieces(chunk: Column) -> Column:
        reach = _running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
        gaps = F.zip_with(spans, F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(spans) - 1)), lambda s, at: F.when(
            s["start"] >= at, F.concat(stretch(chunk, at, s["start"]), F.lit(mark))))
        return F.concat(F.array_join(gaps, ""), stretch(chunk, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    return F.when(F.size(spans) > 0, _let(chunks, pieces)).otherwise(text)


def _count(kind: int) -> Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, as counts, digest and spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, fit(weak_samples(docs))).select("doc_id", "secrets")
    count = [_count(k) for k in range(len(KINDS))]
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select("doc_id", *count[:3], F.sha2(span_text(base), 256).alias("base_sha256"),
                        span_text(F.col("secrets")).alias("spans"), count[3])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret found in a text by a mark; no document goes, and no other column changes but n_chars."""
    # names that the scan itself does not use
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.withColumnsRenamed(names)
    found = find(renamed, fit(weak_samples(docs)), names["text"])
    clean = found.withColumn("clean", redact(F.col(names["text"]), F.col("secrets")))
    columns = {c: F.col(new) for c, new in names.items()} | {"text": F.col("clean")}
    if "n_chars" in names:
        n = F.when(F.size("secrets") > 0, F.length("clean")).otherwise(F.col(names["n_chars"]))
        columns["n_chars"] = n.cast(docs.schema["n_chars"].dataType)
    return clean.select(*[x.alias(c) for c, x in columns.items()])
