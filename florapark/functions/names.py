"""Column helpers for scientific names and life forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values
RANK_MARKER = r"^(subsp|var|f|subvar|forma)\.?$"
RANK_SUFFIX = r"\s+(var|subsp|f|subvar|forma)\.?\s+.*"
# first keyword found wins
GROWTH_FORMS = (("tree", "tree"), ("bamboo", "tree"), ("liana", "shrub"), ("shrub", "shrub"))
DEFAULT_GROWTH_FORM = "herb"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_name(name: Column | str) -> Column:
    return F.translate(F.trim(_col(name)), "\t", " ")


def _words(name: Column) -> Column:
    return F.split(name, r"\s+")


def _taxon_words(words: Column) -> Column:
    """How many leading words form the taxon name: 4 with a rank marker in third place, else 2."""
    marked = (F.size(words) >= 4) & F.coalesce(F.get(words, 2).rlike(RANK_MARKER), F.lit(False))
    return F.when(marked, 4).otherwise(2)


def parsed_name(name: Column | str) -> Column:
    name = _col(name)
    words = _words(name)
    return F.when(F.size(words) <= 2, name).otherwise(F.array_join(F.slice(words, F.lit(1), _taxon_words(words)), " "))


def parsed_author(name: Column | str) -> Column:
    words = _words(_col(name))
    n = _taxon_words(words)
    rest = F.size(words) - n
    return F.when((F.size(words) > 2) & (rest > 0), F.array_join(F.slice(words, n + 1, F.greatest(rest, F.lit(1))), " "))


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 minus edit distance over the longer length; null if either text is missing."""
    a, b = _col(a), _col(b)
    return 1 - F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b)))


def strip_rank(name: Column | str) -> Column:
    return F.regexp_replace(_col(name), RANK_SUFFIX, "")


def growth_form(lifeform: Column | str) -> Column:
    text = F.lower(_col(lifeform))
    out = F.when(text.isNull(), "unknown")
    for keyword, form in GROWTH_FORMS:
        out = out.when(text.contains(keyword), form)
    return out.otherwise(DEFAULT_GROWTH_FORM)
