import corpus_pipeline
from florapark.llm import mixing, packing
from texts import SCHEMA, corpus, odd


def test_stages_follow_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.pin(step(spark, docs, sf_dir))
        assert out.columns == columns, name
        assert 0.8 * docs.count() < out.count() <= docs.count(), name
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_run_equals_its_stages(spark, tmp_path):
    spark.createDataFrame(corpus(80), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.pin(step(spark, docs, str(tmp_path)))
    got = corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect()
    assert sorted(got) == sorted(packing.pack(docs).drop("sequence_id", "offset").collect())


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert mixing.query(spark, str(tmp_path)).count() == 0


def test_order_of_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scan", "mixing", "packing"]


def test_odd_rows_pass_every_stage(spark, tmp_path):
    path = str(tmp_path)
    extra = "text AS secrets, 'b' AS _base, 'c' AS _extra, 'd' AS _clean, 'e' AS _text, 1 AS row, 2 AS _key"
    odd(spark).unionByName(spark.createDataFrame(corpus(60), SCHEMA).selectExpr("*", "1 AS score", "'x' AS label", "2.5D AS length", "true AS kept", "7 AS key")
                           ).selectExpr("*", extra.split(",")[0], *extra.split(",")[1:5], *extra.split(",")[5:]).write.parquet(path + "/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    docs = spark.read.parquet(path + "/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.pin(step(spark, docs, path))
        assert out.schema.names == docs.schema.names and out.count() <= docs.count(), name
        docs = out
    assert docs.where("secrets is null or secrets != text").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() >= docs.count()
