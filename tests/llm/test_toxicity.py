import random

import numpy as np
import pytest
from florapark.llm import toxicity as t
from texts import SCHEMA, corpus, empty, odd

INSULTS = ["grobnax", "vilpest", "snorkblat"]


def labelled(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i, text, lang, source, size in corpus(n, seed=seed):
        bad = rng.random() < 0.3
        if bad:
            w = text.split(" ")
            w.insert(rng.randrange(len(w)), rng.choice(INSULTS) + rng.choice(["", "s", "ed"]))
            text = " ".join(w)
        docs.append((i, text, lang, source, len(text)))
        labels.append((i, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = labelled(500, 1)
    return t.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"), shards=2)


def test_held_out_accuracy_and_sentences(spark, model):
    docs, labels = labelled(200, 2)
    truth = dict(labels)
    hits = caught = located = 0
    for r in t.score(spark.createDataFrame(docs, SCHEMA), model).collect():
        assert 0 <= r["score"] <= 1
        hits += (r["score"] >= t.THRESHOLD) == bool(truth[r["doc_id"]])
        if truth[r["doc_id"]] and r["score"] >= t.THRESHOLD and r["offending"]:
            caught += 1
            worst = r["offending"][0]
            located += any(x in r["text"][worst["start"]:worst["end"]] for x in INSULTS)
    assert hits / 200 > 0.95 and caught > 30 and located / caught > 0.95


def test_all_offending_sentences_are_reported(spark, model):
    clean = [s for _, t, *_ in corpus(40, seed=8) for s in t.split("\n")][:20]
    lines = [f"é {INSULTS[k % 3]} {s}" if k % 2 else s for k, s in enumerate(clean)]
    docs = spark.createDataFrame([(1, "\n".join(lines), "en", "s", 0)], SCHEMA)
    row = t.score(docs, model).first()
    bad = [s for s in row["offending"] if any(x in row["text"][s["start"]:s["end"]] for x in INSULTS)]
    assert len(bad) == 10 and [s["score"] for s in row["offending"]] == sorted((s["score"] for s in row["offending"]), reverse=True)
    assert {row["text"][s["start"]:s["end"]] for s in bad} == {x.removesuffix(".") for x in lines if x.startswith("é")}
    assert t.score(docs, model, most_spans=3).first()["offending"] == row["offending"][:3]


def test_many_mild_sentences_are_reported(spark):
    mild = t.BagModel(np.zeros(1 << t.BITS, np.float32), -2.5)  # p = 0.076 each
    rows = [(1, ". ".join(["some words"] * 12), "en", "s", 0), (2, ". ".join(["some words"] * 2), "en", "s", 0)]
    out = {r["doc_id"]: r for r in t.score(spark.createDataFrame(rows, SCHEMA), mild).collect()}
    p = 1 / (1 + np.exp(2.5))
    need = next(k for k in range(1, 13) if 1 - (1 - p) ** k >= t.THRESHOLD)
    assert out[1]["score"] >= t.THRESHOLD and len(out[1]["offending"]) == need
    assert out[2]["score"] < t.THRESHOLD and out[2]["offending"] == []


def test_noisy_or_equals_the_product():
    m = t.BagModel(None, 0.0)
    logits, rows = np.array([-2.0, 0.5, -9.0, 1.0]), np.array([0, 0, 2, 2])
    p = 1 / (1 + np.exp(-logits))
    expected = [1 - (1 - p[0]) * (1 - p[1]), 0.0, 1 - (1 - p[2]) * (1 - p[3])]
    assert np.allclose(t._document_scores(m, t._log_not(logits), rows, 3), expected, atol=1e-9)


def test_odd_rows_and_empty_tables(spark, model):
    out = t.score(odd(spark), model)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == 11 and rows[900]["score"] == rows[901]["score"] < 0.01 and rows[900]["offending"] == []
    assert out.columns == [c for c in odd(spark).columns if c != "score"] + ["score", "offending"]
    assert t.score(empty(spark), model).count() == 0
    none = t.fit(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["score"] < 0.01 for r in t.score(odd(spark), none).collect())


def test_query(spark, sf_dir):
    out = t.query(spark, sf_dir)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
