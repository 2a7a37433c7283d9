"""I-Match fingerprints: hashes of the mid-frequency terms of a text under randomised lexicons.

The lexicon holds the terms that occur in a share of the documents inside a band, which
is a band of inverse document frequency. Its size cannot exceed (mean distinct terms of
a document) / (low end of the band), whatever the corpus. Every subset keeps each
lexicon term by a draw of its own; the sorted distinct terms of a text that lie in a
subset are hashed, one hash per subset. A text with fewer than ``FEW`` lexicon terms
(short, or of rarer terms than the band holds) draws its subsets from all its distinct
terms, and where a subset misses them all the hash is of all its terms; only a text
without any term has empty subsets throughout. Only column expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from florapark.llm._store import pin

BAND = (0.01, 0.3)  # shares of documents: idf between ln(1 / 0.3) and ln(1 / 0.01)
SUBSETS = 48
FEW = 8  # lexicon terms below which a text is known by all its terms
_PER_RATE = 16  # subsets keep 1/16, then 1/64, then 1/256 of the lexicon
_INLINE = 50_000  # lexicon terms written into the plan; a larger lexicon is joined
_NO_ID = -(1 << 63)


def terms(text: Column) -> Column:
    """Sorted distinct 64-bit hashes of the lower-cased runs of letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """(term, df): hashed terms whose share of all documents lies in ``band``. Counted over all documents."""
    n = docs.count()
    low, high = band[0] * n, band[1] * n
    return (
        docs.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
        .groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(low, high))
    )


def with_lexicon_terms(rows: DataFrame, text: str, lexicon_rows: DataFrame, out: str, key: str) -> DataFrame:
    """``rows`` with ``out`` (terms, few): the sorted distinct lexicon terms of ``text``, or all its terms where those are few.

    ``key`` must be unique per row.
    """
    n = lexicon_rows.count()
    every = terms(F.coalesce(F.col(text), F.lit("")))

    def chosen(mine: Column, all_terms: Column) -> Column:
        few = F.size(mine) < FEW
        return F.struct(F.when(few, all_terms).otherwise(mine).alias("terms"), few.alias("few"))

    def bound(x: Column, use) -> Column:
        # bound to a name first, so that it is worked out once
        return F.get(F.transform(F.array(x), use), F.lit(0))

    if n <= _INLINE:
        listed = ",".join(str(r["term"]) for r in lexicon_rows.select("term").collect())
        known = F.split(F.lit(listed), ",").cast("array<long>") if listed else F.array().cast("array<long>")
        return rows.withColumn(out, bound(every, lambda t: bound(F.array_intersect(t, known), lambda mine: chosen(mine, t))))
    found = (
        rows.select(key, F.explode(every).alias("term"))
        .join(lexicon_rows.select("term"), "term").groupBy(key).agg(F.sort_array(F.collect_list("term")).alias("_mine"))
    )
    empty = F.array().cast("array<long>")
    return rows.join(found, key, "left").withColumn(out, chosen(F.coalesce("_mine", empty), every)).drop("_mine")


def fingerprint(chosen: Column) -> Column:
    """One hash (int) per subset of ``chosen`` (terms, few); null where the text has no term of it and its terms are not few."""

    def of(mine: Column, few: Column, k: Column) -> Column:
        # the first 4, 6 or 8 bits of a hash of (term, subset) must be 0
        limit = F.when(k < _PER_RATE, 16).when(k < 2 * _PER_RATE, 4).otherwise(1)
        kept = F.filter(mine, lambda t: F.shiftrightunsigned(F.xxhash64(t, k), 56) < limit)
        short = lambda m: F.shiftright(F.xxhash64(m), 32).cast("int")
        return F.get(F.transform(F.array(kept), lambda m: F.when(F.size(m) > 0, short(m)).when(few & (F.size(mine) > 0), short(mine))), F.lit(0))

    # bound to a name first, so that the terms are worked out once and not per subset
    return F.get(F.transform(F.array(chosen), lambda c: F.transform(
        F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: of(c["terms"], c["few"], k))), F.lit(0))


def as_text(hashes: Column) -> Column:
    """Eight hexadecimal digits per subset, hyphens where it is empty."""
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(F.lpad(F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"), F.lit("-" * 8))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets in which either text has a hash; 1 for equal fingerprints, so also for two texts without any term."""
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x == y, F.lit(False))))
    seen = F.filter(both, lambda x: x.isNotNull())
    return F.when(F.size(seen) == 0, F.lit(1.0)).otherwise(F.size(F.filter(seen, lambda x: x)) / F.size(seen))


def next_ids(ids: DataFrame) -> DataFrame:
    """(key, next_key, before_key) for each row of ``ids`` (key, unique): neighbours in ascending order, as a ring.

    Ids are sorted in range partitions and numbered; the only step in one task runs over
    one row per partition. The pinned numbering is joined with itself.
    """
    local = pin(ids.repartitionByRange("key").sortWithinPartitions("key").withColumn("mono", F.monotonically_increasing_id()))
    part = F.shiftright("mono", 33)
    sizes = local.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pin(sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    total = starts.count() and local.count()
    at = F.col("mono") - F.shiftleft(part, 33)
    # one row per partition of the sort above
    placed = pin(local.withColumn("part", part).join(F.broadcast(starts), "part").select("key", (F.col("start") + at).alias("i"), *[c for c in ids.columns if c != "key"]))
    after = placed.select(F.col("key").alias("next_key"), F.pmod(F.col("i") - 1, F.lit(max(total, 1))).alias("i"))
    prior = placed.select(F.col("key").alias("before_key"), F.pmod(F.col("i") + 1, F.lit(max(total, 1))).alias("i"),
                          *[F.col(c).alias(f"before_{c}") for c in ids.columns if c != "key"])
    return pin(placed.join(after, "i").join(prior, "i").drop("i"))


def compare_with_edits(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of all ``docs`` (doc_id, text) and of their edited texts, with likenesses.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as
    many of the next document in ascending doc_id, or all of it; after the last comes the
    first. Null texts are empty. A null doc_id comes before all others. Rows with equal
    doc_id count as one place in the order; each is edited with the first text, in binary
    order, of the next doc_id. Other columns are not read.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    rows = docs.select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    known = pin(lexicon(rows, "text", band))
    ids = rows.groupBy("key").agg(F.max(F.length("text")).alias("half"))
    ring = next_ids(ids.withColumn("half", F.floor(F.col("half") / 2).cast("long")))
    # whole texts move once; the halves taken from the next document move a second time
    at = rows.join(ring.select("key", F.col("before_key").alias("to"), F.col("before_half").cast("int").alias("take")), "key")
    heads = at.select(F.col("to").alias("key"), F.substring("text", F.lit(1), F.col("take")).alias("head"))
    first = heads.groupBy("key").agg(F.min("head").alias("head"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = at.select("key", "text").join(first, "key").select(
        "key", "text", n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("head", F.lit(1), half)).alias("edited"))
    # the join names rows by number, so they are written first
    both = pin(edited.withColumn("_row", F.monotonically_increasing_id())) if known.count() > _INLINE else edited
    both = with_lexicon_terms(both, "text", known, "t_own", "_row")
    both = with_lexicon_terms(both, "edited", known, "t_edited", "_row")
    done = pin(
        both.select("key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "t_own", "t_edited")
        .select("key", "n_chars", "edited_sha256", fingerprint(F.col("t_own")).alias("own"), fingerprint(F.col("t_edited")).alias("changed"))
    )
    following = (
        ring.select(F.col("next_key").alias("key"), F.col("key").alias("of"))
        .join(done.groupBy("key").agg(F.min("own").alias("next_own")), "key").select(F.col("of").alias("key"), "next_own")
    )
    return done.join(following, "key").select(
        F.when(F.col("key") != _NO_ID, F.col("key")).alias("doc_id"), "n_chars", "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
