"""Near duplicates by SimHash: fingerprints that meet on one-wildcard variants of a segment.

1. Each text gets a 64-bit fingerprint, the bitwise majority of its shingle hashes. Equal
   fingerprints are one class from there on.
2. ``bits`` differing bits spread over (bits + 2) // 2 segments leave at most one in some
   segment (two segments of 32 bits for 3). Every fingerprint is indexed under each of
   its segments with each single bit left open, 64 variants in all: fingerprints that
   are near enough share a variant, and equality of variants brings them together.
3. The members of a variant are compared in full inside the task that holds it. A search
   from member to member over those not yet reached yields links that connect exactly
   what the near pairs connect, fewer than members, whatever their number.
4. A variant with more members than ``LIMIT`` is not compared but indexed again: the bits
   it leaves open are cut into bits + 1 blocks, of which near fingerprints agree in one.
   With 48 bits fixed there can be no more than ``LIMIT`` members, so this ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from florapark.llm._store import drop, pin, ship
from florapark.llm.components import connected

LIMIT = 1 << 16  # members of a variant that are compared in one task
_LAG = 8  # variants of up to so many members are compared with shifted columns
_BLOCK = 1 << 15  # shingles whose bits are counted at once
SEED = 42


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the shingles (``width`` words, repeats included) of a UTF-8 text with A-Z lower-cased.

    A bit is set when it is set in over half of the XXH64 values. A text of fewer words is
    one shingle; one without words gives 0.
    """
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    starts = (ends - size).tolist()
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    stops = (ends[width - 1:] - 1).tolist()
    n, counts = len(stops), np.zeros(64, np.int64)
    for k in range(0, n, _BLOCK):
        parts = [joined[a:b] for a, b in zip(starts[k:k + _BLOCK], stops[k:k + _BLOCK])]
        h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.dtype("<u8"), len(parts))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint: the 64 bits as a long) per row of ``docs`` (doc_id, text); null texts are empty."""
    ship(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, "doc_id long, fingerprint long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def variant_masks(bits: int) -> list[int]:
    """The bits that each variant keeps: one segment without one of its bits."""
    n = (bits + 2) // 2
    edge = [64 * k // n for k in range(n + 1)]
    out = []
    for a, b in zip(edge, edge[1:]):
        segment = (1 << b) - (1 << a)
        out += [_signed(segment & ~(1 << i)) for i in range(a, b)]
    return out


def finer_masks(mask: int, bits: int) -> list[int]:
    """``mask`` with one of ``bits`` + 1 blocks of its open bits added; near fingerprints agree in one of the blocks."""
    open_bits = [i for i in range(64) if not mask >> i & 1]
    return [_signed(mask % (1 << 64) | sum(1 << i for i in open_bits[k::bits + 1])) for k in range(bits + 1)]


def _near(members: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the members as all their near pairs do."""
    left, a, b, queue = members[1:], [], [], [members[0]]
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        x = queue.pop()
        hit = np.bitwise_count(left ^ x) <= bits
        if hit.any():
            found, left = left[hit], left[~hit]
            a.append(np.full(len(found), x)), b.append(found)
            queue.extend(found)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(fp: np.ndarray, cuts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the variants that begin at ``cuts`` (and end with the rows)."""
    size = np.diff(cuts)
    variant = np.repeat(np.arange(len(size)), size)
    few = size[variant] <= _LAG
    a, b = [], []
    for lag in range(1, min(_LAG, len(fp))):
        same = (variant[lag:] == variant[:-lag]) & few[lag:]
        if not same.any():
            break
        x, y = fp[:-lag][same], fp[lag:][same]
        near = np.bitwise_count(x ^ y) <= bits
        a.append(x[near]), b.append(y[near])
    for k in np.flatnonzero(size > _LAG):
        x, y = _near(fp[cuts[k]:cuts[k + 1]], bits)
        a.append(x), b.append(y)
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
    return pair[:, 0], pair[:, 1]


def within_variants(indexed: DataFrame, bits: int) -> DataFrame:
    """(again, x, y) from rows (mask, fp): links (false, fp, fp), or rows of too large variants (true, mask, fp).

    Rows are dealt by variant and arrive in its order; a task holds one variant at a time.
    """
    parts = int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col("fp").bitwiseAND(F.col("mask"))
    dealt = indexed.withColumn("value", value).repartition(parts, "mask", "value").sortWithinPartitions("mask", "value", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = fp = np.zeros(0, np.int64)
        large = None  # the variant whose members are passed on
        for batch in batches:
            m = batch.column("mask").to_numpy(zero_copy_only=False)
            f = batch.column("fp").to_numpy(zero_copy_only=False)
            if large is not None:
                stays = (m == large[0]) & (f & m == large[1])
                yield _out(True, m[stays], f[stays])
                m, f = m[~stays], f[~stays]
                if not len(m):
                    continue
                large = None
            mask, fp = np.concatenate([mask, m]), np.concatenate([fp, f])
            cuts = _cuts(mask, fp)
            last = cuts[-2] if len(cuts) > 1 else 0  # the last variant may go on in the next batch
            yield _out(False, *_links(fp[:last].view(np.uint64), cuts[:-1], bits))
            mask, fp = mask[last:], fp[last:]
            if len(fp) > LIMIT:
                large = mask[0], mask[0] & fp[0]
                yield _out(True, mask, fp)
                mask = fp = np.zeros(0, np.int64)
        if len(fp):
            yield _out(False, *_links(fp.view(np.uint64), _cuts(mask, fp), bits))

    return dealt.select("mask", "fp").mapInArrow(compare, "again boolean, x long, y long")


def _cuts(mask: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Where each variant begins, and the end."""
    if not len(fp):
        return np.zeros(1, np.int64)
    value = mask & fp
    new = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
    return np.r_[0, new, len(fp)]


def _out(again: bool, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(x), again)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["again", "x", "y"])


def near_pairs(fps: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps`` (fp), connecting exactly those that near pairs connect."""
    ship(fps.sparkSession)
    masks = F.array(*[F.lit(m).cast("long") for m in variant_masks(bits)])
    found = pin(within_variants(fps.select(F.explode(masks).alias("mask"), "fp"), bits))
    links, done = found.where("not again"), [found]
    rest = found.where("again")
    while not rest.isEmpty():
        finer = F.udf(lambda m: finer_masks(m, bits), "array<long>")
        # few masks: one per variant that was too large
        masks = rest.select(F.col("x").alias("mask")).distinct().withColumn("finer", F.explode(finer("mask")))
        again = rest.select(F.col("x").alias("mask"), F.col("y").alias("fp")).join(masks, "mask")
        found = pin(within_variants(again.select(F.col("finer").alias("mask"), "fp").distinct(), bits))
        links, rest = links.unionByName(found.where("not again")), found.where("again")
        done.append(found)
    out = pin(links.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    drop(*done)
    return out


def as_text(fp: Column) -> Column:
    """Sixteen lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text).

    Texts are linked when their fingerprints differ in at most ``bits`` bits;
    ``component_id`` is the smallest doc_id of those reachable over links. Null and empty
    texts have fingerprint 0 and are linked like any other. Rows with the same doc_id are
    linked with each other, whatever their texts. A row without doc_id gets the smallest
    doc_id reachable from it, null if there is none. Other columns are not read.
    """
    sketch = pin(fingerprints(docs, width))
    classes = pin(sketch.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    near = near_pairs(classes.select(F.col("fingerprint").alias("fp")), bits)
    # a doc_id whose rows have different texts
    own = sketch.where("doc_id is not null").distinct()
    several = own.groupBy("doc_id").agg(F.min("fingerprint").alias("b"), F.max("fingerprint").alias("_m")).where("b != _m")
    joined = own.join(several, "doc_id").where("fingerprint != b").select(F.col("fingerprint").alias("a"), "b")
    root = pin(connected(near.unionByName(joined)))
    placed = classes.join(root.withColumnRenamed("id", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(ids, "root").select("fingerprint", "component_id")
    return sketch.join(named, "fingerprint").select("doc_id", as_text(F.col("fingerprint")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents over three-word shingles, at 3 or fewer differing bits."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
