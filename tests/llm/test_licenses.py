import math
import re
from collections import Counter

from florapark.llm import licence_texts, licenses as m
from texts import SCHEMA, corpus, empty, odd

NOTICE = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "Proprietary": "All rights reserved."}


def documents(spark):
    rows = corpus(60)
    for k, (name, line) in enumerate(NOTICE.items()):
        rows += [(100 + k, f"{line}\n{rows[k][1]}", "en", "s", 0), (110 + k, f"{rows[k][1]}\n{line.upper()}", "en", "s", 0)]
    rows += [(200, "the license was apache but not this work of version 2", "en", "s", 0),
             (201, "This work is licensed under the GNU General Public License version 3", "en", "s", 0)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def words(text):
    return [w for w in re.split(r"[^0-9A-Za-z\u0080-\U0010ffff]+", (text or "").lower()) if w]


def by_hand(rows):
    """Cosine of every line and every whole text with every template, without any filter."""
    vocabulary = {w for ts in m.TEMPLATES.values() for t in ts for w in words(t)}
    df = Counter(w for r in rows for w in set(words(r[1])) & vocabulary)
    n = len(rows)
    idf = {w: math.log((n + 1) / (df[w] + 1)) + 1 for w in vocabulary}

    def vector(ws):
        v = {w: c * idf.get(w, math.log(n + 1) + 1) for w, c in Counter(ws).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / size for w, x in v.items()}

    templates = [(name, vector(words(t))) for name, ts in m.TEMPLATES.items() for t in ts]
    out = {}
    for i, text, *_ in rows:
        best = []
        for part in [*(text or "").split("\n"), text or ""]:
            v = vector(words(part))
            best += [(-sum(x * v.get(w, 0) for w, x in t.items()), name) for name, t in templates]
        score, name = min(best)
        if -score >= m.THRESHOLD:
            out[i] = (name, round(-score, 9))
    return out


def test_notices_equal_a_plain_search(spark):
    rows, docs = documents(spark)
    got = {r["doc_id"]: (r["license"], round(r["score"], 9)) for r in m.notices(docs, m.fit(docs)).collect()}
    assert got == by_hand(rows) and {100, 101, 102, 110, 111, 112, 201} <= set(got) and 200 not in got


def test_wrapped_headers_and_long_licence_files(spark):
    import textwrap

    gpl, bsd, mit = m.TEMPLATES["GPL-3.0"][2], m.TEMPLATES["BSD-3-Clause"][1], m.TEMPLATES["MIT"][2]
    prose = "\n".join(t for _, t, *_ in corpus(40, seed=5))
    rows, expected = [], {}
    for k, (name, text) in enumerate((("GPL-3.0", gpl), ("BSD-3-Clause", " ".join(bsd.split())), ("MIT", " ".join(mit.split())))):
        for width in (30, 60, 72, 100_000):
            header = "\n".join("# " + x for x in textwrap.wrap(text, width))
            rows += [(len(rows), f"{prose}\n{header}\n{prose}", "en", "s", 0)]
            expected[len(rows) - 1] = name
    paragraph = " ".join(mit.split())[:400]
    rows += [(len(rows), f"{prose}\n{paragraph}", "en", "s", 0)]
    expected[len(rows) - 1] = "MIT"
    for name, text in (("GPL-3.0", licence_texts.GPL_3), ("Apache-2.0", licence_texts.APACHE_2)):
        rows += [(len(rows), text, "en", "s", 0), (len(rows) + 1, f"{prose}\n{prose}\n{text}", "en", "s", 0)]
        expected |= {len(rows) - 2: name, len(rows) - 1: name}
    assert len(words(licence_texts.GPL_3)) > 2_000
    rows += [(1000 + i, t, *r) for i, t, *r in corpus(60, seed=6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in m.notices(docs, m.fit(docs)).collect()}
    assert {i: r["license"] for i, r in got.items()} == expected
    assert got[13]["covered"] == got[15]["covered"] == 1.0 and got[14]["covered"] > 0.4


def test_windows_equal_a_plain_search(spark):
    rows, docs = documents(spark)
    matcher = m.fit(docs)
    text = words(" ".join(rows[k][1] for k in range(60, len(rows))))
    best = {}
    for score, name, start, end in matcher.windows(text):
        assert abs(score - max(sum(x * v.get(w, 0.0) for w, x in t.items()) for n, t in matcher.vectors if n == name
                               for v in [matcher.vector(text[start:end])])) < 1e-9
        best[name] = max(best.get(name, 0), score)
    for (name, t), size in zip(matcher.vectors, matcher.sizes):
        for s in range(len(text) - size):
            v = matcher.vector(text[s:s + size])
            score = sum(x * v.get(w, 0.0) for w, x in t.items())
            assert score < matcher.threshold or best[name] >= score - 1e-9


def test_nearest_ancestor(spark):
    files = spark.createDataFrame([(1, "LICENSE"), (2, "a/COPYING.txt"), (3, "a/b/x.c"), (4, "c/y.c"), (5, "a/b/own.c"), (6, None), (7, "ab/z"), (8, "a/b/c/d/e.c")],
                                  "doc_id long, path string")
    found = spark.createDataFrame([(1, "MIT", 1.0, 0.1), (2, "Apache-2.0", 0.9, 0.1), (5, "GPL-3.0", 0.8, 0.1)],
                                  "doc_id long, license string, score double, covered double")
    got = {r["doc_id"]: (r["license"], r["how"], r["license_path"]) for r in m.inherit(files, found).collect()}
    assert got == {
        1: ("MIT", "own", "LICENSE"), 2: ("Apache-2.0", "own", "a/COPYING.txt"), 3: ("Apache-2.0", "inherited", "a/COPYING.txt"),
        4: ("MIT", "inherited", "LICENSE"), 5: ("GPL-3.0", "own", "a/b/own.c"), 6: (None, "none", None), 7: ("MIT", "inherited", "LICENSE"),
        8: ("Apache-2.0", "inherited", "a/COPYING.txt")}


def test_odd_rows_and_empty_tables(spark):
    docs = odd(spark)
    assert m.notices(docs, m.fit(docs)).count() == 0
    assert m.notices(empty(spark), m.fit(empty(spark))).count() == 0
    files = docs.selectExpr("doc_id", "concat('d/', doc_id) AS path")
    out = m.inherit(files, m.notices(docs, m.fit(docs)))
    assert out.count() == 11 and out.where("how != 'none'").count() == 0


def test_query(spark, sf_dir):
    out = m.query(spark, sf_dir)
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert out.where("how = 'own'").count() > 0
