import hashlib
import random
import re

import numpy as np
import pytest
from florapark.llm import fillmiddle as m
from pyspark.sql import functions as F
from texts import corpus, empty, odd

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def by_hand(doc_id, text, percent=90, spm=20):
    text = text or ""
    w = TOKEN.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    if not text or any(x in text for x in m.MARKS) or h[2] % 100 >= percent:
        return len(w), "plain", None, None, text
    p, q, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h[3] % 100 < spm:
        return len(w), "spm", len(p), len(q), f"<S>{s}<P>{p}<M>{q}"
    return len(w), "psm", len(p), len(q), f"<P>{p}<S>{s}<M>{q}"


def compare(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = m.transform(df, **kw).withColumn("back", m.restore(F.col("output"), F.col("form"))).collect()
    got = sorted((repr(r["doc_id"]), r["n"], r["form"], r["prefix_chars"] or 0, r["middle_chars"] or 0, r["output"], r["back"]) for r in out)
    want = []
    for i, t in rows:
        n, form, a, b, text = by_hand(i, t, kw.get("percent", 90), kw.get("spm_percent", 20))
        want.append((repr(i), n, form, a or 0, b or 0, text, t or ""))
    assert got == sorted(want)
    return {r["form"] for r in out}


def test_equals_cutting_by_hand_and_is_undone(spark):
    rng = random.Random(2)
    signs = "ab Zé😀<S P>M\n\t9ßｗ"
    rows = [(i, t) for i, t, *_ in corpus(150, seed=6)]
    rows += [(1000 + i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(5000, "a <P> b"), (5001, "<S>"), (5002, "x<M>"), (5003, "<S"), (5004, "P>"), (5005, None), (None, "no id here"), (None, "another one")]
    assert compare(spark, rows) == {"plain", "psm", "spm"}


def test_shares_are_parameters(spark):
    rows = [(i, f"some text {i}") for i in range(50)]
    assert compare(spark, rows, percent=0) == {"plain"}
    assert compare(spark, rows, percent=100, spm_percent=100) == {"spm"}


@pytest.mark.parametrize("seed", range(4))
def test_skip_list_finds_every_rank(seed):
    rng = np.random.default_rng(seed)
    length = rng.integers(1, 400, 12)
    points, first = rng.integers(1, 9, length.sum()), np.r_[0, np.cumsum(length)[:-1]]
    lists = m.SkipList(points, first)
    assert all((u > 0).all() for u in lists.units) and len(lists.units) > 2
    for s, (a, n) in enumerate(zip(first, length)):
        rank = np.arange(n + 1)
        assert (lists.locate(np.full(n + 1, s), rank) == np.r_[0, np.cumsum(points[a:a + n])]).all()


def test_odd_rows_and_empty_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd(spark).collect()]
    compare(spark, rows)
    assert m.transform(odd(spark)).count() == 11
    assert m.transform(empty(spark)).count() == 0
