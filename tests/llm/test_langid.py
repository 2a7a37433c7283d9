import itertools

import numpy as np
import pytest
from florapark.llm import langid as m
from florapark.llm._store import held_back
from pyspark.sql import functions as F
from texts import SCHEMA, corpus, empty, odd, sentence


@pytest.fixture(scope="module")
def model(spark):
    return m.fit(spark.createDataFrame(corpus(240, seed=2), SCHEMA), shards=2)


def chains(rng, lengths, k):
    return rng.normal(size=(len(lengths), max(lengths), k)), rng.normal(size=(k, k)), rng.normal(size=k)


def by_hand(scores, move, start):
    """Posteriors by summing over all label sequences."""
    t, k = scores.shape
    total, unary, pair = 0.0, np.zeros((t, k)), np.zeros((k, k))
    for y in itertools.product(range(k), repeat=t):
        w = np.exp(start[y[0]] + sum(scores[i, y[i]] for i in range(t)) + sum(move[a, b] for a, b in zip(y, y[1:])))
        total += w
        for i in range(t):
            unary[i, y[i]] += w
        for a, b in zip(y, y[1:]):
            pair[a, b] += w
    return unary / total, pair / total


def test_forward_backward_equals_the_sum_over_all_labellings():
    rng = np.random.default_rng(0)
    lengths = np.array([5, 4, 1])
    scores, move, start = chains(rng, lengths, 3)
    unary, pairs = m.forward_backward(scores, lengths, move, start)
    expected = [by_hand(scores[i, :n], move, start) for i, n in enumerate(lengths)]
    for i, n in enumerate(lengths):
        assert np.allclose(unary[i, :n], expected[i][0])
    assert np.allclose(pairs, sum(e[1] for e in expected))
    crf = m.Crf(["a", "b", "c"], None, None, move.astype(np.float32), start.astype(np.float32))
    fast = m._unary(scores.astype(np.float32), lengths, crf)
    assert all(np.allclose(fast[i, :n], expected[i][0], atol=1e-4) for i, n in enumerate(lengths))


def test_long_texts_are_several_chains():
    first, length = m._chains(np.repeat([0, 1, 2], [600, 1, 256]))
    assert sorted(zip(first, length)) == [(0, 256), (256, 256), (512, 88), (600, 1), (601, 256)]


def test_held_out_accuracy(spark, model):
    docs = spark.createDataFrame(corpus(150, seed=77), SCHEMA)
    out = m.predict(docs, model).where("n_words >= 10")
    assert out.where("lang_pred = lang").count() / out.count() > 0.97


def test_words_of_mixed_text(model):
    import random

    rng = random.Random(3)
    text = sentence(rng, "en", 15) + " " + sentence(rng, "de", 15)
    labels = [x[1] for x in m.label_words(model, text)]
    assert labels[:12].count("en") >= 10 and labels[-12:].count("de") >= 10


def test_odd_rows_and_empty_tables(spark, model):
    out = m.predict(odd(spark), model)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == 11 and out.columns == [c for c in odd(spark).columns if c != "score"] + ["lang_pred", "score", "n_words"]
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (900, 901, 902, 903))
    assert rows[905]["lang_pred"] == "en" and rows[905]["n_words"] == 90_000
    nothing = m.fit(empty(spark))
    assert m.predict(empty(spark), model).count() == 0
    assert {r["lang_pred"] for r in m.predict(odd(spark), nothing).collect()} == {"und"}


def test_query_learns_from_the_other_folds(spark, sf_dir):
    out = m.query(spark, sf_dir)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", held_back(F.col("doc_id"), 5, 0).alias("h"))
    both = out.join(truth, "doc_id").where("held_out")
    assert both.where("held_out != h").count() == 0 and both.where("lang_pred = lang").count() / both.count() > 0.9


def test_stage_drops_only_texts_without_language(spark):
    docs = spark.createDataFrame([r for r in corpus(300) if len(r[1].split()) >= 5], SCHEMA).unionByName(spark.createDataFrame([(900, "12 34", "en", "s", 5), (901, None, "en", "s", 0)], SCHEMA))
    out = m.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count() - 2


def test_stage_keeps_an_even_mixture_of_languages(spark):
    import random

    rng = random.Random(5)
    made = {"it": ["che", "gli", "della", "sono", "anche", "nella", "questo", "perche", "molto", "tutti"]}
    four = [*corpus(300, seed=6), *[(400 + i, " ".join(rng.choices(made["it"], k=60)), "it", "s", 0) for i in range(100)]]
    mixed = [(1000 + i, "\n".join([sentence(rng, k, 15) for k in ("en", "de", "fr")] + [" ".join(rng.choices(made["it"], k=15))]), None, "s", 0)
             for i in range(20)]
    junk = [(2000, "жщыш щфыц ъэжю", None, "s", 0), (2001, "12 34", None, "s", 5)]
    docs = spark.createDataFrame(four + mixed + junk, SCHEMA)
    shares = [r["score"] for r in m.predict(docs.where("doc_id >= 1000 AND doc_id < 2000"), m.fit(docs)).collect()]
    assert max(shares) < 0.4  # the largest share of an even mixture
    assert {r["doc_id"] for r in m.stage(spark, docs, "").select("doc_id").collect()} == {r[0] for r in four + mixed}


def test_stage_keeps_all_when_no_language_was_learned(spark):
    docs = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert m.stage(spark, docs, "").count() == docs.count() == 11


def test_stage_drops_strings_of_chance_in_any_script(spark):
    import random

    rng = random.Random(12)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "".join(chr(0x4E00 + k) for k in range(400))]
    junk = [(5000 + i, " ".join("".join(rng.choices(a, k=rng.randint(3, 9))) for _ in range(40)), None, "s", 0)
            for i, a in enumerate(alphabets * 20)]
    clean = [r for r in corpus(400, seed=13) if len(r[1].split()) >= 3]
    out = {r["doc_id"] for r in m.stage(spark, spark.createDataFrame(clean + junk, SCHEMA), "").select("doc_id").collect()}
    assert out == {r[0] for r in clean}


def test_evidence_counts_every_labelled_text(spark):
    """More texts of a language than any sample held, and 3-grams of one text only."""
    texts = [(i, f"abc d{i % 7}\u00e9", "aa" if i % 3 else "bb", "s", 1) for i in range(1500)] + [(9001, "zzz", None, "s", 1), (9002, "", "aa", "s", 1), (9003, None, "bb", "s", 1)]
    docs = spark.createDataFrame(texts, SCHEMA)
    found = m.fit_evidence(docs, docs)
    want, unit = np.zeros((1 << m._EVIDENCE_BITS, 2)), np.ones(256)
    for _, t, y, *_ in texts:
        if t and y:
            data = np.frombuffer(f"\n{t}\n".encode(), np.uint8)
            np.add.at(want[:, ["aa", "bb"].index(y)], m._three(data)[2:], 1)
            unit += np.bincount(m._FOLD[data], minlength=256)
    assert np.array_equal(found.count, want) and np.allclose(found.unit, np.log(unit / unit.sum()), atol=1e-6) and found.total.tolist() == want.sum(0).tolist()


def test_only_texts_go_to_the_workers_and_are_judged_once(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox", "x"), (2, None, "y")], "doc_id long, text string, other string")
    judged = m.predict(docs, m.Crf.empty([]))
    rows = {r["doc_id"]: r for r in judged.collect()}
    assert judged.columns == ["doc_id", "text", "other", "lang_pred", "score", "n_words"] and rows[2]["lang_pred"] == "und" and rows[1]["other"] == "x"
    plan = judged.where("lang_pred = 'und'").select("doc_id", "score")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
