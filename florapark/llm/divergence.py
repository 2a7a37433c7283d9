"""How far the word use of each source lies from the other sources of its language, from exact counts.

Terms are counted inside the tasks, chunk by chunk, by length: terms of up to 8 bytes are
packed into one uint64 and those of up to 16 into two, put in order by counting passes of
16 bits and counted as runs; longer terms are sorted as bytes in buckets of doubling
width. What leaves a task is one row per (language, source, term) of a chunk, with the
number of occurrences and of documents; Spark adds these up.

The divergence of two sources is a sum over all kept terms of the language. A term that a
source does not have still has its smoothed share, the same for all such terms. The sum
is therefore put together from three exact parts: the smoothed shares alone, the terms of
either source against the smoothed share of the other (by the histogram of counts), and a
correction for terms that both have, taken term by term where the sources of a term meet.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from florapark.llm._bytes import chunks, row_of, word_spans
from florapark.llm._store import few, pin, ship

SCALE = 1_000_000_000
_CHUNK = 4 << 20
_CELLS = 1 << 18  # (term, source) cells that are compared at once
_SUMS = 1 << 18  # sums a task holds before they are passed on
_GROUPS = 100_000  # (language, source) rows sent to all executors at most; more are joined by a shuffle
_ENDS = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def radix_order(keys: Sequence[np.ndarray]) -> np.ndarray:
    """Stable order of rows by columns of uint64, the first the most significant.

    One counting pass per 16 bits (numpy sorts uint16 that way), the least significant
    first; digits that are the same everywhere are passed over.
    """
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in (0, 16, 32, 48):
            digit = (key >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def pack(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of each span (8 at most) as one uint64, first byte highest, zeros behind; spans without bytes are 0."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    at = np.ndarray((len(data) + 8,), ">u8", padded, strides=(1,))[starts].astype(np.uint64)
    drop = (64 - 8 * np.clip(length, 0, 8)).astype(np.uint64)
    # in two steps, since shifting by all 64 bits is undefined
    half = drop >> np.uint64(1)
    return at >> half >> (drop - half) << half << (drop - half)


def _runs(order: np.ndarray, same_term: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the first, occurrences, documents) of each run of one term in one group; ``same_term`` tells of each row in order whether its term is its predecessor's."""
    g, d = group[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = ~same_term[1:] | (g[1:] != g[:-1])
    new_doc = new.copy()
    new_doc[1:] |= d[1:] != d[:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order))), np.add.reduceat(new_doc.astype(np.int64), at)


def _strings(raw: np.ndarray) -> pa.Array:
    """Rows of a byte matrix, zeros behind left out, as text."""
    used = raw != 0
    offsets = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(used.sum(1), out=offsets[1:])
    return pa.StringArray.from_buffers(len(raw), pa.py_buffer(offsets), pa.py_buffer(raw[used].tobytes()))


def count_terms(part: bytes, offsets: np.ndarray, group: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, group, occurrences, documents) per length class of texts joined by a line feed; ``group`` numbers each text's group."""
    data = _LOWER[np.frombuffer(part, np.uint8)]
    starts, ends = word_spans(data, _ENDS)
    doc, length = row_of(starts, offsets), ends - starts
    for words in (1, 2):
        at = np.flatnonzero((length > 8 * (words - 1)) & (length <= 8 * words))
        if not len(at):
            continue
        s, n, d = starts[at], length[at], doc[at]
        keys = [pack(data, s + 8 * k, n - 8 * k) for k in range(words)]
        g = group[d]
        order = radix_order([*keys, g.astype(np.uint64)])
        same = np.zeros(len(order), bool)
        same[1:] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
        first, count, docs = _runs(order, same, g, d)
        raw = np.stack([k[first] for k in keys], 1).astype(">u8").view(np.uint8).reshape(len(first), -1)
        yield _strings(raw), g[first], count, docs
    low, width = data.tobytes(), 32
    while (length > width // 2).any():
        at = np.flatnonzero((length > width // 2) & (length <= width))
        if len(at):
            d = doc[at]
            terms = np.array([low[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())], f"S{width}")
            g = group[d]
            by_group = np.argsort(g, kind="stable")
            order = by_group[np.argsort(terms[by_group], kind="stable")]
            same = np.zeros(len(order), bool)
            same[1:] = terms[order][1:] == terms[order][:-1]
            first, count, docs = _runs(order, same, g, d)
            yield _strings(terms[first].view(np.uint8).reshape(len(first), width)), g[first], count, docs
        width *= 2


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): partial counts of the terms of ``docs`` (text, lang, source), to be added up."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.table([batch.column("lang"), batch.column("source")], names=["lang", "source"])
            groups = pair.group_by(["lang", "source"]).aggregate([])
            place = {p: i for i, p in enumerate(zip(groups["lang"].to_pylist(), groups["source"].to_pylist()))}
            group = np.fromiter((place[p] for p in zip(pair["lang"].to_pylist(), pair["source"].to_pylist())), np.int64, batch.num_rows)
            for first, end, part, offsets in chunks(batch.column("text"), _CHUNK):
                for terms, g, n, n_docs in count_terms(part, offsets, group[first:end]):
                    yield pa.RecordBatch.from_arrays(
                        [groups["lang"].combine_chunks().take(pa.array(g)), groups["source"].combine_chunks().take(pa.array(g)),
                         terms, pa.array(n, pa.int64()), pa.array(n_docs, pa.int64())], ["lang", "source", "term", "n", "n_docs"])

    return docs.select("text", "lang", "source").mapInArrow(count, "lang string, source string, term string, n long, n_docs long")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 (n + 1) / (total + kept)) in whole numbers."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(n + 1), whole(total + kept)) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 1e9 + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value differs from the one before; true for the first."""
    code = pa.concat_arrays(column.chunks).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.r_[True, code[1:] != code[:-1]] if len(code) else np.zeros(0, bool)


def _add_shared(block: pa.Table, sums: dict) -> None:
    """Add the corrections of whole terms of one language to ``sums`` (lang, source, item)."""
    source = block["source"].combine_chunks().dictionary_encode()
    names, col = source.dictionary.to_pylist(), source.indices.to_numpy(zero_copy_only=False)
    if len(names) < 2:
        return
    lang, term, p = block["lang"][0].as_py(), np.cumsum(_changes(block["term"])) - 1, block["p"].to_numpy()
    p0 = np.zeros(len(names), np.int64)
    p0[col] = block["p0"].to_numpy()
    rows, n_terms = max(1, _CELLS // len(names)), int(term[-1]) + 1
    for low in range(0, n_terms, rows):
        at = slice(*np.searchsorted(term, [low, low + rows]))
        table = np.tile(p0, (min(rows, n_terms - low), 1))
        table[term[at] - low, col[at]] = p[at]
        has = np.zeros(table.shape, bool)
        has[term[at] - low, col[at]] = True
        for b, name in enumerate(names):
            mine = table[has[:, b]]
            q = mine[:, b:b + 1]
            # 0 where the other source has not got the term, since its share is the smoothed one
            extra = _gap(mine, q) - _gap(mine, p0[b]) - _gap(p0, q) + _gap(p0, p0[b])
            for a, v in enumerate(extra.sum(0).tolist()):
                if a != b and v:
                    sums[lang, names[a], name] += v


def _sum_rows(sums: dict) -> pa.RecordBatch:
    lang, source, item = zip(*sums)
    return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(source), pa.array(item), pa.array(list(sums.values()), pa.int64())],
                                      ["lang", "source", "item", "value"])


def shared_terms(shares: DataFrame) -> DataFrame:
    """(lang, source, item, value): corrections for terms that both sources have, from rows (lang, term, source, p, p0).

    Terms are dealt out by hash; a task compares the sources of its terms a block of cells
    at a time and gives one sum per pair of sources, so no pairs of rows are made.
    """
    ship(shares.sparkSession)
    parts = int(shares.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shares.select("lang", "term", "source", "p", "p0").repartition(parts, "lang", "term").sortWithinPartitions("lang", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = None, defaultdict(int)

        def take(table: pa.Table) -> None:
            cuts = np.flatnonzero(_changes(table["lang"]))
            for a, b in zip(cuts, [*cuts[1:], table.num_rows]):
                _add_shared(table.slice(a, b - a), sums)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            # the last term may go on in the next batch
            last = int(np.flatnonzero(_changes(table["lang"]) | _changes(table["term"]))[-1])
            take(table.slice(0, last))
            held = table.slice(last)
            if len(sums) > _SUMS:
                yield _sum_rows(sums)
                sums.clear()
        if held is not None:
            take(held)
        if sums:
            yield _sum_rows(sums)

    return dealt.mapInArrow(run, "lang string, source string, item string, value long")


def kept_counts(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the terms in at least ``min_docs`` documents of their language.

    ``lang_n`` is the count over all sources; ``first`` marks one row of each (lang, term).
    """
    counted = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    # as many rows as there are sources
    of_term = Window.partitionBy("lang", "term")
    return counted.select(
        "lang", "source", "term", "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("n_docs").over(of_term).alias("df"),
        (F.min("source").over(of_term) == F.col("source")).alias("first")).where(F.col("df") >= min_docs).drop("df")


def divergence(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) from ``docs`` (text, lang, source).

    ``pair``: the other sources of the language, with the divergence of the source from
    them over all kept terms (0 where the language keeps none). ``term``: the ``top`` terms
    that the source uses more than its language does. Null text, lang and source count as
    ''. Every row is a document, also one that repeats. A group without terms takes part
    with its smoothed shares. Memory of a task follows its chunks and the longest single
    text. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = pin(kept_counts(rows, min_docs))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("v"))
    groups = few(
        rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "v")])
        .withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v")))), _GROUPS)
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"), "p0")
    return _pairs(shares, groups).unionByName(_terms(shares, top))


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """The part ``pair``; as many rows as there are pairs of sources of a language."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    each = groups.join(other, "lang").where("source != item")
    base = each.select("lang", "source", "item", F.coalesce(F.col("v") * gap(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    # terms of either side against the smoothed share of the other; terms with equal counts are taken together
    histogram = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k")).join(other, "lang").where("source != item")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    sides = F.explode(F.array(
        F.struct(F.col("source").alias("source"), F.col("item").alias("item"), (F.col("k") * (gap(p, q0) - gap(p0, q0))).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("k") * (gap(q0, p) - gap(q0, p0))).alias("value"))))
    single = histogram.select("lang", sides.alias("s")).select("lang", "s.*")
    value = base.unionByName(single).unionByName(shared_terms(shares)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return value.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(shares: DataFrame, top: int) -> DataFrame:
    """The part ``term``; each task passes on its ``top`` rows of a group at most."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return (
        shares.where("p > q").select("lang", "source", "term", gap(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source of the documents from the other sources of its language."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))
