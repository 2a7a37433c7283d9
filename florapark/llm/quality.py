"""Quality rules whose cutoffs keep the share of good documents they reject under a chosen risk.

Each rule rejects a document whose statistic lies above a cutoff. Cutoffs are tried
from lax to strict on labelled documents that were used for nothing else, per stratum:
a cutoff is certified when the exact binomial test rejects "more than ``risk`` of the
good documents are lost" at level delta / (strata x rules), and all laxer ones are
certified too (fixed-sequence testing). All certified cutoffs hold together with
probability 1 - delta, so the one used may be picked freely among them. Only column
expressions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from florapark.llm._store import pin

SPACES = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """Reject where ``value`` (an SQL expression) exceeds a cutoff; ``cutoffs`` from lax to strict."""

    name: str
    value: str
    cutoffs: tuple[float, ...]


def _falling(high: float, low: float, n: int = 40) -> tuple[float, ...]:
    return tuple(high * (low / high) ** (k / (n - 1)) for k in range(n))


def rules() -> list[Rule]:
    """The rules of the query, on the columns of ``with_statistics``."""
    return [
        Rule("symbols", "n_symbols / greatest(word_chars, 1)", _falling(1.0, 0.005)),
        Rule("upper", "n_upper / greatest(word_chars, 1)", _falling(1.0, 0.02)),
        Rule("exclaims", "n_exclaims / greatest(n_words, 1)", _falling(1.0, 0.01)),
        Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", _falling(1.0, 0.02)),
        Rule("repeats", "n_repeat_words / greatest(n_words, 1)", _falling(1.0, 0.02)),
    ]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a three-word window found twice or more in the array."""

    def count(w: Column) -> Column:
        m = F.size(w) - 2

        def places(windows: Column) -> Column:
            # equal windows become neighbours; sorting pairs of (hash, place) keeps long texts cheap
            placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            twins = _let(placed, lambda s: F.zip_with(
                F.slice(s, F.lit(1), m - 1), F.slice(s, F.lit(2), m - 1),
                lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2))))
            return F.size(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))

        pairs = F.zip_with(F.slice(w, F.lit(2), m), F.slice(w, F.lit(3), m), lambda b, c: F.xxhash64(b, c))
        windows = F.zip_with(F.slice(w, F.lit(1), m), pairs, lambda a, h: F.xxhash64(a, h))
        return F.when(m < 2, F.lit(0)).otherwise(
            _let(windows, lambda x: F.when(F.size(F.array_distinct(x)) == m, F.lit(0)).otherwise(places(x))))

    return _let(words, count)


def with_statistics(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_exclaims, text_hash.

    Words are runs of characters other than ASCII white space; lines are split at line
    feeds and count if they hold a word. Null texts are empty: all counts 0.
    """
    t = F.col("_text")
    words = F.filter(F.split(t, SPACES, -1), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    less = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    return (
        docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
        .select(*keep, "_text", words.alias("_words"), lines.alias("_lines"))
        .select(
            *keep, F.size("_words").cast("long").alias("n_words"),
            F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            less("[#*$%&|<>]").cast("long").alias("n_symbols"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
            less(r"\p{Lu}").cast("long").alias("n_upper"), less("!").cast("long").alias("n_exclaims"),
            F.xxhash64("_text").alias("text_hash"))
    )


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1, by the asymptotic series at x + 8."""
    y = x + 8
    below = F.lit(1.0)
    for k in range(8):
        below = below * (x + k)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    import math

    return (y - 0.5) * F.log(y) - y + math.log(2 * math.pi) / 2 + series - F.log(below)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(at most k of n) at rate p, exact to double precision; 1 where k is not below the mean.

    Starts at the largest term and follows the falling ratios until they add nothing.
    """
    import math

    n, k = n.cast("double"), k.cast("double")
    top = (_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)
           + k * math.log(p) + (n - k) * math.log1p(-p))
    steps = F.least(k, F.ceil(60 + 12 * F.sqrt(n * p))).cast("int")
    odds = (1 - p) / p
    total = F.aggregate(
        F.when(steps < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), steps - 1)),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda acc, m: _let(acc["term"] * (k - m) / (n - k + m + 1) * odds,
                            lambda t: F.struct(t.alias("term"), (acc["sum"] + t).alias("sum"))),
        lambda acc: acc["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top) * total)


def certify(holdout: DataFrame, risk: float = 0.03, delta: float = 0.05, cost: float = 5.0,
            rule_list: Sequence[Rule] | None = None) -> DataFrame:
    """(stratum, cutoffs: map of rule to cutoff) from labelled rows (stratum, good, text_hash, statistics).

    ``risk`` bounds the share of good documents that all rules together may reject; it is
    shared out evenly among the rules. Of the certified cutoffs the one with the best
    (share of bad rejected) - ``cost`` x (share of good rejected) is used, the laxest of
    equals, and none where that is not above 0. Equal texts count once per stratum, so
    copies do not pass for independent evidence.
    """
    used = list(rule_list) if rule_list is not None else rules()
    each = risk / len(used)
    once = holdout.where(F.col("good").isNotNull()).dropDuplicates(["stratum", "text_hash", "good"])

    def first_cutoff(rule: Rule) -> Column:
        hit = F.array_position(F.transform(F.array(*[F.lit(c) for c in rule.cutoffs]), lambda c: F.expr(rule.value) > c), F.lit(True))
        return F.when(hit == 0, F.lit(len(rule.cutoffs) + 1)).otherwise(hit).cast("int")

    long = once.select("stratum", "good", F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), first_cutoff(r).alias("step")) for r in used])).alias("x"))
    counts = pin(long.groupBy("stratum", "x.rule", "x.step").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")))
    strata = max(1, counts.select("stratum").distinct().count())
    whole = Window.partitionBy("stratum", "rule")
    upto = whole.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cutoff = F.lit(None).cast("double")
    for r in used:
        at = F.get(F.array(*[F.lit(c) for c in r.cutoffs]), F.col("step") - 1)
        cutoff = F.when(F.col("rule") == r.name, at).otherwise(cutoff)
    tested = (
        counts.withColumn("n_good", F.sum("good").over(whole)).withColumn("n_bad", F.sum("bad").over(whole))
        .withColumn("lost", F.sum("good").over(upto)).withColumn("caught", F.sum("bad").over(upto))
        .withColumn("p", binomial_tail(F.col("n_good"), F.col("lost"), each))
        .withColumn("failed", F.max(F.when((F.col("n_good") > 0) & (F.col("p") <= delta / (strata * len(used))), 0).otherwise(1)).over(upto))
        .withColumn("gain", F.col("caught") / F.greatest("n_bad", F.lit(1)) - cost * F.col("lost") / F.greatest("n_good", F.lit(1)))
        .withColumn("cutoff", cutoff)
        .where("failed = 0 and gain > 0 and cutoff is not null")
    )
    best = tested.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", -F.col("step"))).alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def judge(stats: DataFrame, cutoffs: DataFrame, rule_list: Sequence[Rule] | None = None) -> DataFrame:
    """``stats`` with ``rejected_by``: names of the rules whose cutoff in the row's stratum is exceeded."""
    used = list(rule_list) if rule_list is not None else rules()
    found = F.filter(F.array(*[
        F.when(F.expr(r.value) > F.try_element_at("cutoffs", F.lit(r.name)), F.lit(r.name)) for r in used]), lambda x: x.isNotNull())
    of = cutoffs.select(F.col("stratum").alias("_stratum"), "cutoffs")
    return stats.join(of, F.col("stratum") == F.col("_stratum"), "left").withColumn("rejected_by", found).drop("_stratum", "cutoffs")


def score_quality(docs: DataFrame, labels: DataFrame, stratum: Column, risk: float = 0.03, delta: float = 0.05) -> DataFrame:
    """Statistics, base verdict, ``rejected_by`` and ``kept`` for each row of ``docs`` (doc_id, text, ...).

    ``labels`` has (doc_id, quality: 1 good, 0 bad); null ids or labels are no evidence, and
    a document labelled both ways counts as both. Null strata form a stratum of their own.
    Without enough labels nothing is certified and only the base rule rejects.
    """
    stats = pin(with_statistics(docs.withColumn("stratum", F.coalesce(stratum.cast("string"), F.lit(""))),
                                keep=("doc_id", "stratum")))
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 1).alias("good")).distinct()
    cutoffs = pin(certify(stats.join(known, "doc_id"), risk, delta))
    judged = judge(stats, cutoffs)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.withColumn("base_failed", base).withColumn("kept", ~base & (F.size("rejected_by") == 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of every document; cutoffs certified per language on the labelled documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_quality(docs.select("doc_id", "text", "lang"), labels, F.col("lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "rejected_by")
