"""Fixity audit of replicated WARC files with hash trees.

A record's hash is SHA-256 of its bytes. Records lie in a file by byte offset; a node
of level 1 covers an offset range of ``LEAF`` bytes, a node of each higher level
``FANOUT`` neighbouring nodes, and a node's hash covers its children in order. The
roots of two replicas are compared; only where they differ are children compared, down
to the records. Equal files cost one comparison, and a damaged record one per level.

Ranges are fixed byte ranges, so a lost or added record changes only its own branch as
long as the records after it keep their offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from florapark.llm._store import drop, pin
from florapark.operators.ranking import running_sum_in_group

LEAF = 1 << 18
FANOUT = 16
FILE_RECORDS = 200
_SLICE_DIGITS = 3  # hex digits of the hash by which the records of one id are sliced
_LOOSE = 256  # different records without offset per node, about


def warc_payloads(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, record_id, payload) of ``pages`` (page_id, url, html) as WARC 1.0 response records; nothing is moved.

    File ``n`` holds the pages with page_id div ``file_records`` = n. A null url or html is
    empty. Pages without page_id go by the hash of their bytes to the files -1, -2, ..., as
    many as their number calls for. Other columns are not read.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col("url"), F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    nameless = pages.where(F.col("page_id").isNull()).count() // file_records + 1
    return pages.select(
        F.coalesce(F.floor(F.col("page_id") / file_records), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(nameless))).cast("long").alias("file"),
        F.col("page_id").alias("record_id"),
        F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary")).alias("payload"))


def place(records: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """``records`` (file, record_id, length, hash, ...) with their byte ``offset``, by record_id and hash.

    Other columns must follow from these four. Equal records are counted before they move,
    and a file is worked on in slices of a record_id and hash, so neither many copies nor
    many records under one id meet in one task.
    """
    copies = records.withColumn("_split", F.spark_partition_id()).groupBy(*records.columns, "_split").agg(F.count("*").alias("_copies"))
    part = F.conv(F.left("hash", F.lit(_SLICE_DIGITS)), 16, 10).cast("long")
    piece = F.coalesce(F.pmod("record_id", F.lit(file_records)), F.lit(0)) * 16**_SLICE_DIGITS + part
    size = F.col("length") * F.col("_copies")
    ends = running_sum_in_group(copies, ["file"], piece, ["record_id", "hash", "_split"], size, "_end")
    return ends.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(
        "file", (F.col("_end") - size + (F.col("_turn") - 1) * F.col("length")).cast("long").alias("offset"),
        *[c for c in records.columns if c != "file"])


def warc_records(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, offset, length, record_id, payload) of ``pages``: the records of ``warc_payloads`` in their place.

    Pages lie in ascending page_id, repeated page_ids in the order of their SHA-256. Only
    hashes are sorted; the payloads, once each, are joined to their places.
    """
    rows = warc_payloads(pages, file_records).withColumn("hash", F.sha2("payload", 256))
    placed = place(rows.select("file", "record_id", F.octet_length("payload").cast("long").alias("length"), "hash"), file_records)
    bytes_of = rows.groupBy("file", "hash").agg(F.first("payload").alias("payload"))  # equal hash, equal bytes
    return placed.join(bytes_of, ["file", "hash"]).select("file", "offset", "length", "record_id", "payload")


def leaves(records: DataFrame) -> DataFrame:
    """(file, offset, length, record_id, hash) of each record; null payloads hash as empty. A column ``hash`` is taken as it is."""
    known = "hash" in records.columns and "payload" not in records.columns
    digest = F.col("hash") if known else F.sha2(F.coalesce(F.col("payload"), F.lit(b"")), 256)
    return records.select("file", "offset", "length", "record_id", digest.alias("hash"))


def _entries(records: DataFrame) -> DataFrame:
    """Equal records once, with their number: (file, loose, offset, length, hash, copies, record_id); loose ones have no offset."""
    return leaves(records).groupBy(
        F.coalesce("file", F.lit(-1)).cast("long").alias("file"), F.col("offset").isNull().alias("loose"),
        F.coalesce("offset", F.lit(0)).cast("long").alias("offset"), F.coalesce("length", F.lit(0)).cast("long").alias("length"), "hash",
    ).agg(F.count("*").alias("copies"), F.min("record_id").alias("record_id"))


def _above(nodes: DataFrame, level: int, fanout: int) -> DataFrame:
    """Nodes of ``level`` from the level below: (file, node, hash).

    The number of children of a node is bounded by the fan-out, or by the different records
    that fit into its bytes.
    """
    if level == 1:
        child = F.concat_ws(":", *[F.col(c).cast("string") for c in ("offset", "length", "hash", "copies")])
        place, order = F.col("node"), F.struct("offset", "length", child.alias("text"))
    else:
        place = F.floor(F.col("node") / fanout).cast("long")
        order = F.struct(F.col("node"), F.concat_ws(":", F.col("node").cast("string"), F.col("hash")).alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["text"]), ",")
    return nodes.groupBy("file", place.alias("node")).agg(F.sha2(text, 256).alias("hash"))


def levels_for(longest: int, leaf: int = LEAF, fanout: int = FANOUT) -> int:
    """Levels until one node covers a file of ``longest`` bytes."""
    k, covered = 1, leaf
    while covered < longest:
        k, covered = k + 1, covered * fanout
    return k


def audit(one: DataFrame, two: DataFrame, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """(file, offset, record_id, finding, compared) for each record in which two replicas differ.

    Both have (file, offset, length, record_id) and payload or its hash. ``finding`` is
    `changed` where one record of either is left at an offset, else `missing` (only in
    ``one``) or `extra` (only in ``two``); ``compared`` is the number of nodes of the file's
    trees that had to be compared. Records equal in file, offset, length and hash are one
    entry with a count, reported as often as the counts differ, under its smallest
    record_id. Rows without file are filed under file -1. Rows without offset lie under
    nodes of their own, drawn by hash, and are missing or extra, with a null offset. Empty
    replicas are equal.
    """
    low = [pin(_entries(x)) for x in (one, two)]
    sizes = [x.agg(F.max("offset"), F.count_if("loose")).first() for x in low]
    n = levels_for(max(x[0] or 0 for x in sizes) + 1, leaf, fanout)
    nodes = max(x[1] for x in sizes) // _LOOSE + 1
    drawn = -1 - F.conv(F.left("hash", F.lit(14)), 16, 10).cast("long") % nodes
    written = low
    low = [x.withColumn("node", F.when(F.col("loose"), drawn).otherwise(F.floor(F.col("offset") / leaf)).cast("long")) for x in low]
    trees = [[x] for x in low]
    for k in range(1, n + 1):
        for t in trees:
            t.append(pin(_above(t[-1], k, fanout)))

    def differ(a: DataFrame, b: DataFrame) -> DataFrame:
        """(file, node) whose hashes differ or that only one side has, and how many nodes of the file were compared."""
        both = a.select("file", "node", F.col("hash").alias("h1")).join(
            b.select("file", "node", F.col("hash").alias("h2")), ["file", "node"], "full")
        return pin(both.select("file", "node", (~F.col("h1").eqNullSafe(F.col("h2"))).alias("open")))

    seen = differ(trees[0][n], trees[1][n])
    work = [seen.groupBy("file").agg(F.count("*").alias("c"))]
    todo = seen.where("open").select("file", "node")
    for k in range(n - 1, 0, -1):
        def under(t: DataFrame) -> DataFrame:
            up = todo.select("file", F.col("node").alias("_up"))
            return t.withColumn("_up", F.floor(F.col("node") / fanout).cast("long")).join(up, ["file", "_up"], "left_semi")

        seen = differ(under(trees[0][k]), under(trees[1][k]))
        work.append(seen.groupBy("file").agg(F.count("*").alias("c")))
        todo = seen.where("open").select("file", "node")

    at, whole = ["file", "loose", "offset"], ["file", "loose", "offset", "length", "hash"]
    a, b = (x.join(todo, ["file", "node"], "left_semi").select(*whole, F.col("copies").alias(f"n{i}"), F.col("record_id").alias(f"id{i}"))
            for i, x in enumerate(low))
    more = F.coalesce("n0", F.lit(0)) - F.coalesce("n1", F.lit(0))
    left = pin(a.join(b, whole, "full").select(*at, more.alias("more"), F.coalesce("id0", "id1").alias("record_id")).where("more <> 0"))
    alone = F.sum(F.greatest("more", F.lit(0)))
    changed = left.where("NOT loose").groupBy(*at).agg(
        alone.alias("here"), (alone - F.sum("more")).alias("there"), F.min(F.when(F.col("more") > 0, F.col("record_id"))).alias("record_id"),
        F.min("record_id").alias("any_id")).where("here = 1 AND there = 1")
    single = left.join(changed.select(*at), at, "left_anti").withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("more"))))
    found = changed.select("file", "offset", F.coalesce("record_id", "any_id").alias("record_id"), F.lit("changed").alias("finding")).unionByName(
        single.select("file", F.when(~F.col("loose"), F.col("offset")).alias("offset"), "record_id",
                      F.when(F.col("more") > 0, "missing").otherwise("extra").alias("finding")))
    total = work[0]
    for w in work[1:]:
        total = total.unionByName(w)
    total = total.groupBy("file").agg(F.sum("c").alias("compared"))
    result = pin(found.join(total, "file"))
    drop(left, *written, *[x for t in trees for x in t[1:]])
    return result


def damaged(records: DataFrame) -> DataFrame:
    """A replica of ``records`` with repeatable damage: of 256 records by MD5 of the id, one is altered, one lost, one doubled.

    The altered record keeps its length (its last byte turns to `X`); the doubled one gets a
    second copy at twice its offset plus one. Without payloads, ``hash_altered`` has the hash
    of the altered record.
    """
    draw = _draw()
    harmed = (F.col("payload"), _altered()) if "payload" in records.columns else (F.col("hash"), F.col("hash_altered"))
    kept = records.where(draw != "01").withColumn("payload" if "payload" in records.columns else "hash", F.when(draw == "00", harmed[1]).otherwise(harmed[0]))
    again = records.where(draw == "02").withColumn("offset", F.col("offset") * 2 + 1)
    return kept.unionByName(again)


def _draw() -> Column:
    return F.coalesce(F.left(F.md5(F.col("record_id").cast("string").cast("binary")), F.lit(2)), F.lit(""))


def _altered() -> Column:
    return F.concat(F.substring("payload", F.lit(1), F.octet_length("payload") - 1), F.lit(b"X"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in which a damaged replica of the pages' WARC files differs from them.

    Both replicas are hashed where their pages are read; only hashes move.
    """
    rows = warc_payloads(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    hashed = rows.select(
        "file", "record_id", F.octet_length("payload").cast("long").alias("length"), F.sha2("payload", 256).alias("hash"),
        F.when(_draw() == "00", F.sha2(_altered(), 256)).alias("hash_altered"))
    records = pin(place(hashed))
    return audit(records, damaged(records)).select("file", "offset", "record_id", "finding")


QUERY_SQL = """
WITH rows AS (
  SELECT page_id, page_id // 200 AS file,
         octet_length(encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
           || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
           || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || repeat(chr(13) || chr(10), 2)
           || coalesce(html, '') || repeat(chr(13) || chr(10), 2))) AS length,
         left(md5(page_id::VARCHAR), 2) AS draw
  FROM pages
), placed AS (
  SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM rows
)
SELECT file::BIGINT AS file, CASE WHEN draw = '02' THEN place * 2 + 1 ELSE place END AS "offset", page_id AS record_id,
       CASE draw WHEN '00' THEN 'changed' WHEN '01' THEN 'missing' ELSE 'extra' END AS finding
FROM placed WHERE draw IN ('00', '01', '02')
"""
