import hashlib
import re
from collections import Counter

import pytest
from florapark.llm import fingerprints as m
from pyspark.sql import functions as F
from texts import SCHEMA, corpus, empty, odd


def edits(rows):
    rows = sorted(rows)
    out = {}
    for (i, text), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        half = len(text) // 2
        out[i] = text[:len(text) - half] + after[:half]
    return out


def run(spark, rows):
    return {r["doc_id"]: r for r in m.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_edits_and_equal_texts(spark):
    rows = [(7 * i, t) for i, t, *_ in corpus(120, seed=9)]
    rows += [(1001, rows[3][1]), (1002, "é😀" * 50), (1003, ""), (1004, "x")]
    out, edited = run(spark, rows), edits(rows)
    assert {i: r["edited_sha256"] for i, r in out.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in edited.items()}
    assert all(out[i]["n_chars"] == len(t) for i, t in rows)
    assert out[1001]["fingerprint"] == out[21]["fingerprint"]
    assert all(0 <= r[c] <= 1 for r in out.values() for c in ("near_edited", "near_next"))
    mean = lambda c: sum(r[c] for r in out.values()) / len(out)
    assert mean("near_edited") > mean("near_next") + 0.1


def test_lexicon_is_the_band(spark):
    rows = corpus(80, seed=3)
    docs = spark.createDataFrame(rows, SCHEMA)
    df = Counter(w for r in rows for w in {x for x in re.split(r"[\W_]+", r[1].lower()) if x})
    expected = {w: c for w, c in df.items() if 0.1 * 80 <= c <= 0.5 * 80}
    hashed = {r["h"]: r["w"] for r in spark.createDataFrame([(w,) for w in df], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    assert {hashed[r["term"]]: r["df"] for r in m.lexicon(docs, band=(0.1, 0.5)).collect()} == expected


def test_joined_lexicon_gives_the_same(spark, monkeypatch):
    rows = [(i, t) for i, t, *_ in corpus(40, seed=2)]
    inline = run(spark, rows)
    monkeypatch.setattr(m, "_INLINE", 0)
    joined = run(spark, rows)
    assert inline == joined


def test_likeness(spark):
    cases = [([1, 2, None], [1, 3, None], 0.5), ([None, None], [None, None], 1.0), ([1, None], [None, 2], 0.0), ([5], [5], 1.0)]
    for a, b, expected in cases:
        kind = "array<int>"
        row = spark.createDataFrame([(a, b)], f"a {kind}, b {kind}").select(m.likeness(F.col("a"), F.col("b"))).first()
        assert row[0] == expected


@pytest.mark.parametrize("inline", [50_000, 0])
def test_texts_without_lexicon_terms(spark, monkeypatch, inline):
    monkeypatch.setattr(m, "_INLINE", inline)
    common = [(i, t) for i, t, *_ in corpus(300, seed=4)]
    rare = [(1000 + i, " ".join(f"w{i}x{j}" for j in range(n))) for i, n in enumerate((1, 2, 5, 12, 40, 400))]
    same = [(1100, "odd words here"), (1101, "here odd words"), (1102, "..."), (1103, "")]
    out = run(spark, common + rare + same)
    known = {r["term"] for r in m.lexicon(spark.createDataFrame(common + rare + same, "doc_id long, text string")).collect()}
    hashed = spark.createDataFrame(rare, "doc_id long, text string").select(F.explode(m.terms(F.col("text"))).alias("t"))
    assert known and not known & {r["t"] for r in hashed.collect()}
    assert all(out[i]["near_next"] == 0 and "-" not in out[i]["fingerprint"] for i, _ in rare)
    assert all(out[i]["near_edited"] < 1 for i, t in rare)
    assert out[1100]["near_next"] == 1 and out[1101]["near_next"] == 0 and out[1102]["near_next"] == 1
    assert set(out[1102]["fingerprint"]) == set(out[1103]["fingerprint"]) == {"-"}


def test_odd_rows_and_empty_tables(spark):
    out = m.compare_with_edits(odd(spark)).collect()
    assert len(out) == 11 and {r["n_chars"] for r in out if r["doc_id"] == 900} == {0}
    assert m.compare_with_edits(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "alone here")], "doc_id long, text string")
    assert m.compare_with_edits(one).first()["edited_sha256"] == hashlib.sha256(b"alonealone").hexdigest()


def test_no_python_in_the_plan(spark, sf_dir):
    plan = m.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
