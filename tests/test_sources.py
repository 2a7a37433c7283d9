"""Readers, validation, names and streaming."""

import pytest
from florapark.functions import features as X, names as N
from florapark.operators import cleaning as C, properties as R, taxonomy as T
from florapark.sources import predictions as P, tables as S
from florapark.streaming.ingest import ingest, read_increments
from pyspark.sql import functions as F


def test_malformed_rows_are_skipped(spark, tmp_path):
    head = "\t".join(f.name for f in S.OCCURRENCE_SCHEMA.fields)
    good = "Abies alba\t8.1\t46.2\tCH\t1\t77\tPinaceae\tSPECIES\t10\t2001\tHUMAN_OBSERVATION\tX\tY"
    odd = "Abies alba\tnorth\t46.2\tCH\tmany\t78\tPinaceae\tSPECIES\t10\t2000.0\tHUMAN_OBSERVATION\tX\tY"
    (tmp_path / "occ.csv").write_text("\n".join([head, good, odd, good + "\tZ", "Abies alba\t8.1"]) + "\n")
    df = S.read_occurrences(spark, str(tmp_path / "occ.csv"))
    rows = {r["gbifID"]: r for r in df.collect()}
    assert set(rows) == {77, 78} and rows[77]["species"] == "Abies alba"
    # a value of the wrong kind is null and keeps its row
    assert rows[78]["decimalLongitude"] is None and rows[78]["individualCount"] is None and rows[78]["year"] == 2000
    # the same rows whatever is read
    assert df.count() == df.select("species").count() == len(df.select("year", "individualCount").collect()) == 2


def test_reference_points_across_the_meridian(spark):
    import math

    spots = [(179.98, 0.0), (-179.99, 0.0), (179.5, 0.0), (-179.95, 60.0), (10.0, 89.97), (-170.0, 89.97), (0.0, 0.0)]
    occ = spark.createDataFrame(spots, "lon double, lat double")
    points = [(179.99, 0.0, 10_000.0), (179.97, 60.0, 10_000.0), (0.0, 89.95, 20_000.0)]
    ref = spark.createDataFrame(points, "lon double, lat double, radius_m double")

    def away(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(h))

    expected = {s for s in spots if any(away(*s, x, y) <= r for x, y, r in points)}
    for cell in (0.25, 0.7):
        assert {tuple(r) for r in C.near_reference(occ, ref, cell).collect()} == expected
    assert (-179.99, 0.0) in expected and (-170.0, 89.97) in expected


def test_latin1_plots(spark, tmp_path):
    (tmp_path / "p.txt").write_bytes("PlotObservationID\tSpecies\n1\tÖxalis\n".encode("latin-1"))
    assert S.read_plots(spark, str(tmp_path / "p.txt"), "PlotObservationID bigint, Species string").first()["Species"] == "Öxalis"


def test_validation(spark):
    good = spark.createDataFrame([(1, 0, 0.2), (1, 1, 1.0)], "location_id int, species_id int, probability double")
    assert P.validate(good, 2, good).first()["valid"]
    bad = spark.createDataFrame([(1, 0, 1.2), (1, 1, float("nan"))], "location_id int, species_id int, probability double")
    r = P.validate(bad, 3, good.limit(1)).first()
    assert (r["n_out_of_range"], r["n_not_finite"], r["n_pred_only"], r["valid"]) == (1, 1, 1, False)
    with pytest.raises(Exception, match="failed validation"):
        P.validate(bad, 2, strict=True).collect()


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("species"), "event_id", "value")
    source.repartition(5).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ingest(read_increments(spark, str(tmp_path / "in"), source.schema, maxFilesPerTrigger="2"),
               str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    back = spark.read.schema("event_id bigint, value double, species string").parquet(str(tmp_path / "out"))
    assert back.select("species", "event_id", "value").exceptAll(source).count() == 0
    assert back.count() == source.count()


def test_a_repeated_load_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("a b", 1), ("c", 2), (" ", 3), (None, 4)] + [("hot", i) for i in range(10, 110)], "species string, v long")
    S.write_by_species(one, path, rows_per_file=30)
    S.write_by_species(one.where("v > 20"), path, load="two/2024")
    both = sorted(map(tuple, one.where("v NOT IN (3, 4)").unionByName(one.where("v > 20")).collect()))
    for _ in range(2):  # the second load once more
        assert sorted(map(tuple, S.concat_species_files(spark, path).select("species", "v").collect())) == both
        S.write_by_species(one.where("v > 20"), path, load="two/2024")
    # a load with fewer species leaves none of its earlier ones
    S.write_by_species(one.where("v = 2"), path)
    assert sorted(r["species"] for r in S.concat_species_files(spark, path).collect() if r["v"] < 20) == ["c"]
    files = list((tmp_path / "t" / "load=two%2F2024").rglob("*.parquet")) or list((tmp_path / "t").glob("load=two*/species=hot/*.parquet"))
    assert len(files) == 1


def test_a_repeated_batch_leaves_the_same_rows(spark, tmp_path):
    import shutil

    source = spark.range(4000).selectExpr("if(id % 3 = 0, 'rare' || id % 30, 'hot') AS species", "id AS v")
    source.repartition(6, "v").write.parquet(str(tmp_path / "in"))

    def run():
        ingest(read_increments(spark, str(tmp_path / "in"), source.schema, maxFilesPerTrigger="2"), str(tmp_path / "out"), str(tmp_path / "state"),
               rows_per_file=1000).awaitTermination()

    run()
    # as after a failure: the last batch was written, but its commit was lost
    last = max((p for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    assert int(last.name) >= 2
    kept = tmp_path / "set_aside"
    kept.mkdir()
    for p in (last, last.parent / f".{last.name}.crc"):
        if p.exists():
            shutil.move(str(p), str(kept / p.name))
    run()
    back = spark.read.parquet(str(tmp_path / "out")).select("species", "v")
    assert back.count() == source.count() and back.exceptAll(source).count() == 0
    # one file per load and rare species, at most as many as its rows call for otherwise
    for folder in (tmp_path / "out").glob("load=*/species=*"):
        n = len(list(folder.glob("*.parquet")))
        assert n <= (2 if folder.name == "species=hot" else 1)


def test_name_parsing(spark):
    cases = {
        "Abies alba": ("Abies alba", None),
        "Abies alba Mill.": ("Abies alba", "Mill."),
        "Abies alba subsp. alba": ("Abies alba subsp. alba", None),
        "Abies alba var. brevifolia Mattf.": ("Abies alba var. brevifolia", "Mattf."),
        "Abies alba f. pyramidalis (C.) Voss": ("Abies alba f. pyramidalis", "(C.) Voss"),
        "Abies alba subsp.": ("Abies alba", "subsp."),
        "Abies": ("Abies", None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "original_name string")
    got = {r["original_name"]: (r["parsed_name"], r["parsed_author"]) for r in T.parse_names(df).collect()}
    assert got == cases


def test_growth_forms(spark):
    cases = {"shrub or tree": "tree", "perennial": "herb", "climbing subshrub": "shrub", "Bamboo": "tree", "liana": "shrub", None: "unknown"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", N.growth_form("t").alias("g"))
    assert {r["t"]: r["g"] for r in df.collect()} == cases


def test_fuzzy_matches_are_exactly_one_edit_away(spark):
    base = "Quercus pyrenaica subsp. minor"
    variants = [base, base[1:], base + "x", base.replace("minor", "minos"), base.replace("py", "yp"), base[:-2], "Q" + base, base.replace("q", "k")]
    taxa = spark.createDataFrame([(base, None)], "parsed_name string, parsed_author string")
    checklist = spark.createDataFrame(
        [(i, v, "Accepted", None, True, i) for i, v in enumerate(variants)],
        "plant_name_id int, taxon_name string, taxon_status string, taxon_authors string, homotypic boolean, accepted_plant_name_id int")
    got = {r["match_name"] for r in T.match_fuzzy(taxa, checklist).collect()}
    assert got == {base[1:], base + "x", base.replace("minor", "minos"), "Q" + base}
    short = spark.createDataFrame([("Poa annua", None)], "parsed_name string, parsed_author string")
    near = checklist.limit(1).withColumn("taxon_name", F.lit("Poa annus"))
    assert T.match_fuzzy(short, near).count() == 0


def test_resolution_order(spark):
    cols = "parsed_name string, plant_name_id int, match_name string, match_status string, homotypic boolean, accepted_plant_name_id int, match_type string, match_similarity double"
    rows = [
        ("a", 1, "a", "Synonym", True, 9, "Exact", 1.0), ("a", 2, "a", "Accepted", False, 2, "Exact", 0.5),
        ("b", 3, "b", "Synonym", True, 8, "Exact", 0.4), ("b", 4, "b", "Synonym", True, 7, "Exact", 0.9),
        ("c", 5, "c", "Synonym", False, 6, "Exact", 0.4), ("c", 6, "c", "Synonym", False, 6, "Exact", 0.9),
        ("d", 7, "d", "Synonym", False, 1, "Exact", 0.4), ("d", 8, "d", "Synonym", False, 2, "Exact", 0.9),
        ("e", 9, "e", "Synonym", False, 5, "Exact", 0.9),
    ]
    got = {r["parsed_name"]: (r["plant_name_id"], r["accepted_plant_name_id"]) for r in T.resolve_multi(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"a": (2, 2), "b": (4, 7), "c": (5, 6), "d": (7, None), "e": (9, 5)}


def test_quarantine_names_the_first_stage(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "species_id int")
    got = {r["species_id"]: r["reason"] for r in C.quarantine(ids(1, 2, 3), [("one", ids(1, 2)), ("two", ids(1))]).collect()}
    assert got == {3: "one", 2: "two"}


def test_feature_codes(spark):
    one = spark.range(1).select(F.array(F.lit(0.5), F.lit(-2.0)).alias("x"))
    sizes = {c: one.select(F.size(X.maxent_features("x", c)).alias("n")).first()["n"] for c in ("l", "q", "p", "t", "h", "lqpth")}
    assert sizes == {"l": 2, "q": 2, "p": 1, "t": 100, "h": 100, "lqpth": 205}
    with pytest.raises(ValueError, match="z"):
        X.maxent_features("x", "lz")
    spline = one.select(F.aggregate(X.spline_basis("x"), F.lit(0.0), lambda a, v: a + v).alias("s")).first()["s"]
    assert abs(spline - 2.0) < 1e-12  # each predictor's basis adds up to one


def test_normalise_zero_deviation(spark):
    df = spark.range(1).select(
        X.normalise(F.array(F.lit(None).cast("double"), F.lit(3.0)), X.doubles([1, 1]), X.doubles([2, 0])).alias("a"),
        X.normalise(F.array(F.lit(None).cast("double"), F.lit(3.0)), X.doubles([1, 1]), X.doubles([2, 0]), True).alias("b"))
    r = df.first()
    assert r["a"] == [0.0, None] and r["b"] == [0.0, 2.0]


def test_unknown_level(spark):
    df = spark.createDataFrame([(1,)], "species_id int")
    with pytest.raises(ValueError):
        R.occurrence_counts({"subsampled": df})


def test_property_blocks_are_added_once(spark):
    base = spark.createDataFrame([(1, 5)], "species_id int, a int")
    blocks = {"a": spark.createDataFrame([(1, 6)], "species_id int, a int"), "b": spark.createDataFrame([(1, 7)], "species_id int, b int")}
    out, added, skipped = R.property_table(base, blocks)
    assert (added, skipped) == (["b"], ["a"]) and out.first()["a"] == 5
    out, added, _ = R.property_table(base, blocks, force=["a"])
    assert out.first()["a"] == 6


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, rows in (("bucket_a", 100), ("bucket_b", 50)):
            S.write_bucketed(spark.range(rows).selectExpr("id AS location_id", f"id AS {name}"), name, ["location_id"], 4, str(tmp_path / name))
        joined = spark.table("bucket_a").join(spark.table("bucket_b"), "location_id")
        assert joined.count() == 50
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for name in ("bucket_a", "bucket_b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
