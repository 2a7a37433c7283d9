"""Near duplicates by banded MinHash, sequential Bayesian pruning and exact checks.

1. Each text becomes the set of its word shingles (64-bit hashes); texts with equal
   sets form a class, and one member stands for it from there on.
2. ``BANDS`` bands of ``ROWS`` MinHash values propose candidates. At a similarity of
   0.8 a pair meets in no band with probability (1 - 0.8^4)^32 = 5e-8.
3. Candidates of a bucket are compared with a member drawn at random, and the linked
   ones merged into components. Members that then are still outside the largest
   component of a bucket are compared with all members of other components, block
   against block inside tasks; each pair is looked at in the first band it shares, and
   only survivors leave the task. Pairs of large buckets are first counted on sets of
   shortened hashes, an upper bound, so that hardly any but linked pairs leave. A large group of copies costs rows in proportion to its
   size, and no link between different texts that a bucket can show is left out. There is
   no cap on buckets or partners.
4. A candidate is compared on batches of further MinHash values (eight bits each),
   which had no part in the banding. After each batch it is dropped once the posterior
   probability of a similarity of at least the threshold (uniform prior) is below ``miss``.
5. Survivors are confirmed on their full sets, read again from the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from florapark.llm._bytes import chunks, mix, row_of, word_hashes, word_spans
from florapark.llm._store import drop, pin, ship
from florapark.llm.components import connected

BANDS, ROWS = 32, 4
BATCHES, BATCH = 4, 64
_HUB_ROUNDS = 3
_DENSE = 4096  # pairs of a bucket from which they are also counted on shortened sets inside the task
_SIDE = 512  # members of a bucket in one block
_BROADCAST_IDS = 1_000_000  # ids sent to all executors at most (16 MB); beyond, a shuffle join
_N_HASH = BANDS * ROWS + BATCHES * BATCH
_rng = np.random.Generator(np.random.PCG64(99))
_XOR = _rng.integers(1 << 32, size=_N_HASH, dtype=np.uint32)
_MULTIPLY = _rng.integers(1 << 31, size=_N_HASH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BLOCK = 4096
_TEXT_BYTES = 1 << 18  # bytes of text that are hashed together, so that workers stay small


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word windows; a shorter text is one window, a text without words none."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(width, n)
    m = n - width + 1
    h = hashes[:m].copy()
    for k in range(1, width):
        h = mix(h + np.uint64(0x632BE59BD9B4E019)) ^ hashes[k:k + m]
    return np.unique(mix(h + np.uint64(n if n < 4 else width)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set; long sets are read block by block."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(_N_HASH, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), _BLOCK):
        block = (x[k:k + _BLOCK, None] ^ _XOR) * _MULTIPLY
        np.minimum(out, block.min(axis=0), out=out)
    return out


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    for first, end, part, offsets in chunks(texts, _TEXT_BYTES):
        data = np.frombuffer(part, np.uint8)
        starts, ends = word_spans(data)
        hashes = word_hashes(data, starts, ends)
        cuts = np.searchsorted(starts, offsets)
        for i in range(end - first):
            yield shingle_set(hashes[cuts[i]:cuts[i + 1]], width)


def _name(s: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a set."""
    return (int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, proof) per row of ``docs`` (doc_id, text).

    ``set_a`` and ``set_b`` are a 128-bit hash of the set; ``bands`` one key per band;
    ``proof`` the MinHash values kept for verification. Empty sets have null keys.
    """
    ship(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            size, a, b, bands, proof = [], [], [], [], []
            for s in _sets(batch.column("text"), width):
                size.append(len(s))
                if not len(s):
                    a.append(None), b.append(None), bands.append(None), proof.append(None)
                    continue
                x, y = _name(s)
                a.append(x), b.append(y)
                sig = signature(s)
                rows = sig[:BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
                key = lane.copy()
                for k in range(ROWS):
                    key = mix(key ^ rows[:, k])
                bands.append(key.view(np.int64))
                # eight well-mixed bits: the high bits of a minimum are 0 for every large set
                proof.append((mix(sig[BANDS * ROWS:].astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(proof, pa.binary())],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands", "proof"])

    return docs.select("doc_id", "text").mapInArrow(
        sketch, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, proof binary")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(set_a, set_b, shingles) per row of ``docs`` (text) with a non-empty set."""
    return _expanded(docs, width, lambda s: s.view(np.int64), pa.list_(pa.int64()), "shingles array<long>")


def short_sets(docs: DataFrame, width: int) -> DataFrame:
    """(set_a, set_b, short) per row of ``docs`` with a non-empty set: the sorted high halves of the shingle hashes, as bytes."""
    # sorted hashes have sorted high halves
    return _expanded(docs, width, lambda s: (s >> np.uint64(32)).astype(np.uint32).tobytes(), pa.binary(), "short binary")


def _expanded(docs: DataFrame, width: int, value, kind: pa.DataType, column: str) -> DataFrame:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        a, b, v = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(v, kind)], ["set_a", "set_b", column.split()[0]])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for s in _sets(batch.column("text"), width):
                if len(s):
                    rows.append((*_name(s), value(s)))
                    held += len(s)
                if held > 1 << 19:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return docs.select("text").mapInArrow(expand, f"set_a long, set_b long, {column}")


def least_matches(threshold: float, miss: float) -> list[int]:
    """After each batch, the fewest equal values that keep P(similarity >= threshold) at ``miss`` or more.

    With a uniform prior the posterior of the rate of equal values after m of n is
    Beta(m + 1, n - m + 1); different values still agree in eight bits once in 256.
    """
    rate, out = threshold + (1 - threshold) / 256, []
    for k in range(1, BATCHES + 1):
        n, m = k * BATCH, 0
        while sum(comb(n + 1, j) * rate**j * (1 - rate) ** (n + 1 - j) for j in range(m + 1)) < miss:
            m += 1
        out.append(m)
    return out


def _not_ruled_out(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, floor: list[int]) -> np.ndarray:
    """Which pairs of rows (i of x, j of y) keep enough equal values after every batch."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k in range(BATCHES):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (x[i[alive], part] == y[j[alive], part]).sum(1)
        alive = alive[matches[alive] >= floor[k]]
    return alive


def _proofs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BATCHES * BATCH)


def survivors(pairs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b, proof_a, proof_b, n_a, n_b) that the batches do not rule out, as (a, b, n_a, n_b)."""
    floor = least_matches(threshold, miss)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.arange(batch.num_rows)
                keep = pa.array(_not_ruled_out(_proofs(batch.column("proof_a")), _proofs(batch.column("proof_b")), rows, rows, floor))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("a", "b", "n_a", "n_b")],
                                                 ["a", "b", "n_a", "n_b"])

    return pairs.select("a", "b", "n_a", "n_b", "proof_a", "proof_b").mapInArrow(
        compare, "a long, b long, n_a long, n_b long")


def _shared_upper(short: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Overlap of the shortened sets (sorted 32-bit values) of each pair of rows; never below that of the full sets."""
    out = np.zeros(len(i), np.int64)
    order = np.argsort(i, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(i[order]) != 0])
    for a, b in zip(cuts, [*cuts[1:], len(i)]):
        at = order[a:b]
        own = np.frombuffer(short[i[at[0]]], np.uint32)
        parts = [np.frombuffer(short[k], np.uint32) for k in j[at]]
        flat = np.concatenate(parts)
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        out[at] = np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, parts[:-1])]))
    return out


def _compare_block(g: dict, percent: int, floor: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (outside member, other member) of the surviving pairs of one block of one bucket."""
    left, right = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
    root, n, ids = g["root"], g["n"], g["id"]
    small, large = np.minimum(n[left, None], n[right]), np.maximum(n[left, None], n[right])
    fit = (root[left, None] != root[right]) & (100 * small >= percent * large)
    # two outside members meet twice; keep one of the two
    fit &= ~g["outside"][right] | (ids[left, None] < ids[right])
    i, j = np.nonzero(fit)
    i, j = left[i], right[j]
    keep = []
    for k in range(0, len(i), 1 << 16):
        a, b = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
        first = (g["bands"][a] == g["bands"][b]).argmax(1)
        here = np.flatnonzero(g["bands"][a, first] == g["bucket"])
        here = here[_not_ruled_out(g["proof"], g["proof"], a[here], b[here], floor)]
        if "short" in g and len(here):
            shared = _shared_upper(g["short"], a[here], b[here])
            here = here[100 * shared >= percent * (n[a[here]] + n[b[here]] - shared)]
        keep.append(k + here)
    kept = np.concatenate(keep) if keep else np.zeros(0, np.int64)
    return i[kept], j[kept]


def _across(outside: DataFrame, rest: DataFrame, sizes: DataFrame, sketch: DataFrame, percent: int, miss: float,
            short: DataFrame | None = None) -> DataFrame:
    """Surviving pairs (a, b, n_a, n_b) between ``outside`` and ``rest`` members (bucket, id, root) of the same bucket.

    Both sides are cut into blocks of about ``_SIDE`` members; each pair of blocks is one group.
    With ``short`` (cls, short) pairs must also pass on their shortened sets.
    """
    floor = least_matches(percent / 100, miss)
    blocks = sizes.select("bucket", F.ceil(F.col("n_out") / _SIDE).cast("int").alias("out_blocks"),
                          F.ceil(F.col("n_rest") / _SIDE).cast("int").alias("rest_blocks"))
    spread = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = outside.join(blocks, "bucket").select(
        "bucket", spread(F.col("out_blocks")).alias("ob"), every(F.col("rest_blocks")).alias("rb"),
        F.lit(0).alias("side"), "id", "root", F.lit(True).alias("outside"))
    right = rest.join(blocks, "bucket").select(
        "bucket", every(F.col("out_blocks")).alias("ob"), spread(F.col("rest_blocks")).alias("rb"),
        F.lit(1).alias("side"), "id", "root", "outside")
    rows = left.unionByName(right).join(
        sketch.select(F.col("cls").alias("id"), F.col("n_shingles").alias("n"), "bands", "proof"), "id")
    fields = ["bucket", "ob", "rb", "side", "id", "root", "n", "outside", "bands", "proof"]
    if short is not None:
        rows, fields = rows.join(short.withColumnRenamed("cls", "id"), "id"), [*fields, "short"]
    parts = int(outside.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "bucket", "ob", "rb").sortWithinPartitions("bucket", "ob", "rb", "side", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            done, held = _whole_groups(held)
            if done is not None:
                yield from _pairs_of(done)
        if held is not None and held.num_rows:
            yield from _pairs_of(held)

    def _pairs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {c: t.column(c).to_numpy() for c in ("bucket", "ob", "rb", "side", "id", "root", "n", "outside")}
        proof = _proofs(t.column("proof"))
        short_of = t.column("short").to_pylist() if "short" in t.schema.names else None
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, BANDS)
        cuts = _group_starts(cols)
        for a, b in zip(cuts, [*cuts[1:], t.num_rows]):
            g = {c: v[a:b] for c, v in cols.items()} | {"proof": proof[a:b], "bands": bands[a:b], "bucket": cols["bucket"][a]}
            if short_of is not None:
                g["short"] = short_of[a:b]
            i, j = _compare_block(g, percent, floor)
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (g["id"][i], g["id"][j], g["n"][i], g["n"][j])], ["a", "b", "n_a", "n_b"])

    return dealt.select(*fields).mapInArrow(
        compare, "a long, b long, n_a long, n_b long")


def _group_starts(cols: dict) -> np.ndarray:
    key = np.stack([cols["bucket"], cols["ob"].astype(np.int64), cols["rb"].astype(np.int64)], 1)
    return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(key) else np.zeros(0, np.int64)


def _whole_groups(t: pa.Table) -> tuple[pa.Table | None, pa.Table]:
    """The rows of all groups but the last, which may go on in the next batch, and the rest."""
    cuts = _group_starts({c: t.column(c).to_numpy() for c in ("bucket", "ob", "rb")})
    if len(cuts) < 2:
        return None, t
    return t.slice(0, cuts[-1]), t.slice(cuts[-1])


def _texts_of(named: DataFrame, classes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` that may stand for the classes ``named`` (cls), pinned class names with their set hashes)."""
    names = pin(named.distinct().join(classes.select("cls", "set_a", "set_b", F.col("least").alias("doc_id")), "cls"))
    few = names.count() <= _BROADCAST_IDS
    ids = names.select("doc_id").distinct()
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), names


def _exact(open_pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pinned ``open_pairs`` (a, b, n_a, n_b) of classes whose full sets overlap by at least ``percent``, as (a, b)."""
    rows, names = _texts_of(open_pairs.select(F.col("a").alias("cls")).unionByName(open_pairs.select(F.col("b").alias("cls"))), classes, docs)
    # a doc_id may have rows with other texts, so a set is known by its hash
    sets = pin(full_sets(rows, width).join(names.select("cls", "set_a", "set_b"), ["set_a", "set_b"]).dropDuplicates(["cls"]).select("cls", "shingles"))
    both = (
        open_pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("s_a")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("s_b")), "b")
    )
    shared = F.size(F.array_intersect("s_a", "s_b"))
    links = pin(both.where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b"))
    drop(open_pairs, sets, names)
    return links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Two texts are linked when 100 * |A and B| >= ``percent`` * |A or B| over their
    word-shingle sets. ``component_id`` is the smallest doc_id of those reachable over
    links. Null and empty texts are linked with nothing. A row without doc_id
    stands alone, with component_id null and kept true; several rows with one doc_id
    form one group, whatever their texts. Other columns of ``docs`` are not read.
    """
    key = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = pin(sketches(key, width))
    sets = ["set_a", "set_b", "n_shingles"]
    # one class for each set, under a number of its own
    classes = pin(
        sketch.where(F.col("doc_id").isNotNull() & F.col("set_a").isNotNull())
        .groupBy(*sets).agg(F.min("doc_id").alias("least")).withColumn("cls", F.monotonically_increasing_id())
    )
    rows = pin(sketch.select("doc_id", *sets).join(classes.drop("least"), sets, "left").select("doc_id", "n_shingles", "cls"))
    heads = sketch.join(classes.withColumnRenamed("least", "doc_id"), [*sets, "doc_id"])
    rep = pin(heads.select("cls", "n_shingles", "bands", "proof").dropDuplicates(["cls"]))
    member = rep.select(F.col("cls").alias("id"), F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = pin(member.join(shared.select("bucket"), "bucket", "left_semi"))
    texts = key.where(F.col("doc_id").isNotNull())
    side = rep.select("cls", "n_shingles", "proof")

    # classes of one doc_id belong together
    own = rows.where("doc_id is not null and cls is not null").select("doc_id", "cls").distinct()
    several = own.groupBy("doc_id").agg(F.min("cls").alias("b"), F.max("cls").alias("_m")).where("b != _m")
    roots = pin(connected(pin(own.join(several, "doc_id").where("cls != b").select(F.col("cls").alias("a"), "b"))))
    for turn in range(_HUB_ROUNDS):
        placed = pin(members.join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root")))
        # a hub drawn anew for each bucket and round; buckets of one component have nothing left to compare
        hubs = placed.groupBy("bucket").agg(
            F.min_by(F.struct("id", "root"), F.xxhash64("id", "bucket", F.lit(turn))).alias("hub"),
            (F.min("root") != F.max("root")).alias("mixed")).where("mixed")
        near_hub = placed.join(hubs, "bucket").where("root != hub.root").select(
            F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()
        sized = (
            near_hub.join(side.select(F.col("cls").alias("a"), F.col("n_shingles").alias("n_a"),
                                      F.col("proof").alias("proof_a")), "a")
            .join(side.select(F.col("cls").alias("b"), F.col("n_shingles").alias("n_b"),
                              F.col("proof").alias("proof_b")), "b")
            # sets of very different size cannot overlap enough
            .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        )
        links = _exact(pin(survivors(sized, percent / 100, miss)), classes, texts, width, percent)
        before, roots = roots, pin(connected(links.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))))
        drop(before, links, placed)

    # members that still are outside the largest component of a bucket
    placed = members.join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    largest = placed.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n_rest"), F.max("n").alias("n_main"))
    sizes = pin(largest.select("bucket", "main", "n_rest", (F.col("n_rest") - F.col("n_main")).alias("n_out")).where("n_out > 0"))
    rest = pin(placed.join(sizes.select("bucket", "main"), "bucket").select("bucket", "id", "root", (F.col("root") != F.col("main")).alias("outside")))
    dense = pin(sizes.where(F.col("n_out") * F.col("n_rest") > _DENSE))
    thin = sizes.where(F.col("n_out") * F.col("n_rest") <= _DENSE)
    found = _across(rest.where("outside"), rest, thin, rep, percent, miss)
    if not dense.isEmpty():
        # large buckets are also counted on shortened sets inside the tasks, so that hardly any but linked pairs leave them
        near, names = _texts_of(rest.join(dense.select("bucket"), "bucket", "left_semi").select(F.col("id").alias("cls")), classes, texts)
        short = pin(short_sets(near, width).join(names.select("cls", "set_a", "set_b"), ["set_a", "set_b"]).dropDuplicates(["cls"]).select("cls", "short"))
        found = found.unionByName(_across(rest.where("outside"), rest, dense, rep, percent, miss, short))
    extra = _exact(pin(found), classes, texts, width, percent)
    drop(members, rest, sizes)
    final = pin(connected(extra.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))))

    whole = classes.select("cls", "least").join(final.withColumnRenamed("id", "cls"), "cls", "left").select(
        "cls", F.coalesce("root", "cls").alias("root"), "least")
    ids = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    named = whole.join(ids, "root").select("cls", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = rows.join(named, "cls", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents over sets of four-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs.select("doc_id", "text"), width=4)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates (five-word shingles, similarity 0.8), that with the smallest doc_id.

    Rows are compared and dropped one by one, also where they share a doc_id or have none.
    """
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    rows = pin(docs.withColumnsRenamed(names).withColumn("row", F.monotonically_increasing_id()))
    text, doc_id = names["text"], names["doc_id"]
    parts = near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col(text).alias("text"))).select(F.col("doc_id").alias("row"), "component_id")
    # the smallest row number only decides between rows with equal doc_id and text
    order = F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), F.col("row"))
    first = parts.join(rows.select("row", order.alias("order")), "row").groupBy("component_id").agg(F.min("order").alias("order"))
    kept = first.select("order.row")
    return rows.join(kept, "row", "left_semi").select(*[F.col(new).alias(c) for c, new in names.items()])
