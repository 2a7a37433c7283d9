import hashlib

from florapark.llm import fixity as f
from pyspark.sql import functions as F

RECORD = "file long, offset long, length long, record_id long, payload binary"


def files(spark, n_files=3, n=40):
    rows = [(k, 100 * i, 100, 1000 * k + i, bytes([i % 251]) * 100) for k in range(n_files) for i in range(n)]
    return rows, spark.createDataFrame(rows, RECORD)


def test_damage_is_located(spark):
    rows, one = files(spark)
    two = [(*r[:4], b"?" * 100) if r[3] == 1007 else r for r in rows if r[3] != 2011] + [(0, 1234, 3, 99, b"new")]
    out = {(r["file"], r["offset"], r["record_id"], r["finding"]) for r in f.audit(one, spark.createDataFrame(two, RECORD), leaf=256, fanout=4).collect()}
    assert out == {(1, 700, 1007, "changed"), (2, 1100, 2011, "missing"), (0, 1234, 99, "extra")}


def test_only_mismatching_branches_are_compared(spark):
    rows, one = files(spark, 1, 1000)
    two = spark.createDataFrame([(*r[:4], b"?" * 100) if r[3] == 500 else r for r in rows], RECORD)
    found = f.audit(one, two, leaf=1000, fanout=4).collect()
    # one root, then four children on each of the levels below it
    levels = f.levels_for(99_901, 1000, 4)
    assert len(found) == 1 and found[0]["compared"] <= 1 + 4 * (levels - 1)


def test_equal_and_empty_replicas(spark):
    _, one = files(spark)
    assert f.audit(one, one).count() == 0
    none = spark.createDataFrame([], RECORD)
    assert f.audit(none, none).count() == 0
    assert f.audit(one, none).where("finding = 'missing'").count() == 120


def test_ties_and_nulls(spark):
    rows = [(0, 0, 1, 1, b"a"), (0, 0, 1, 2, b"b"), (None, None, None, None, None), (0, 0, 1, 1, b"a")]
    one, two = spark.createDataFrame(rows, RECORD), spark.createDataFrame([rows[1], rows[3], rows[2]], RECORD)
    assert f.audit(one, one).count() == 0 and f.audit(one, two).count() >= 1


def test_records_without_offset_are_spread_and_counted(spark):
    rows = [(None, None, None, i, b"r%d" % i) for i in range(1500)] + [(None, None, None, 7000, b"same")] * 900
    two = [r for r in rows if r[3] not in (3, 44)][:-2] + [(None, None, None, 9000, b"new")]
    got = f.audit(spark.createDataFrame(rows, RECORD), spark.createDataFrame(two, RECORD)).collect()
    assert sorted((r["record_id"], r["finding"]) for r in got) == [(3, "missing"), (44, "missing"), (7000, "missing"), (7000, "missing"), (9000, "extra")]
    assert {(r["file"], r["offset"]) for r in got} == {(-1, None)}


def test_copies_and_nameless_pages_fill_files_without_gaps(spark):
    rows = [(5, "u", "x")] * 700 + [(5, "u", f"y{i}") for i in range(300)] + [(None, "u", f"z{i}") for i in range(900)] + [(None, None, None)] * 50 + [(7, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = f.warc_records(pages).collect()
    assert len(got) == len(rows) and len({r["file"] for r in got if r["file"] < 0}) == 5
    for name in {r["file"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["file"] == name), key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] == len(r["payload"])
            at += r["length"]
    assert f.warc_records(pages.limit(0)).count() == 0


def test_only_hashes_are_sorted(spark, sf_dir):
    rows = f.warc_payloads(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    low = rows.select("file", "record_id", F.octet_length("payload").cast("long").alias("length"), F.sha2("payload", 256).alias("hash"))
    plan = f.place(low)._jdf.queryExecution().optimizedPlan().toString()
    window = plan[:plan.index("Window")]
    assert "html" not in window and "payload" not in window


def test_records_are_whole(spark):
    pages = spark.createDataFrame([(0, "http://a", "hé"), (1, None, None), (450, "u", "x"), (None, "n", "y"), (1, None, None)], "page_id long, url string, html string")
    rows = f.warc_records(pages).orderBy("file", "offset").collect()
    assert [r["file"] for r in rows] == [-1, 0, 0, 0, 2]
    assert bytes(rows[1]["payload"]) == ("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:0>\r\nWARC-Target-URI: http://a\r\n"
                                         "Content-Length: 3\r\n\r\nhé\r\n\r\n").encode()
    assert rows[2]["offset"] == rows[1]["length"] == len(rows[1]["payload"])


def test_query_equals_sql(spark, sf_dir):
    from compare import connect

    got = sorted(map(tuple, f.query(spark, sf_dir).select("file", "offset", "record_id", "finding").collect()))
    assert got == sorted(connect(sf_dir).sql(f.QUERY_SQL).fetchall())


def test_leaf_hash(spark):
    _, one = files(spark, 1, 1)
    assert f.leaves(one).first()["hash"] == hashlib.sha256(bytes([0]) * 100).hexdigest()
    assert f.leaves(one.withColumn("payload", F.lit(None).cast("binary"))).first()["hash"] == hashlib.sha256(b"").hexdigest()
