import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from florapark.llm import divergence as d
from texts import SCHEMA, corpus, empty, odd

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(rows, min_docs=3, top=200):
    df, count = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source, w = lang or "", source or "", terms(text)
        df[lang].update(set(w))
        count[lang, source].update(w)
    out = set()
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        v = len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + v) for t in kept}
        sources = {s: share(count[k, s]) for k, s in count if k == lang}
        whole = share(sum((count[lang, s] for s in sources), Counter()))
        for s, p in sources.items():
            pairs = [(o, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)) for o, q in sources.items() if o != s]
            own = [(t, (p[t] - whole[t]) ** 2 // whole[t]) for t in kept if count[lang, s][t] and p[t] > whole[t]]
            for part, items in (("pair", pairs), ("term", own)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, x, k + 1) for k, (i, x) in enumerate(items) if part == "pair" or k < top}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = [tuple(r) for r in d.divergence(df, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def sample(n, seed=3):
    rng = random.Random(seed)
    words = ["a", "Tree", "über", "eight888", "exactly8", "ninebytes", "sixteenbytesword", "seventeenbytesxyz", "ÀÉÎ" * 9, "x" * 40, "y" * 70, "日本語", "straße", "z" * 33]
    return [(" ,".join(rng.choice(words) + rng.choice(["", "s", "en"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None]),
             rng.choice(["s1", "s2", "s3", "é4"])) for _ in range(n)]


def test_equals_counting_by_hand(spark):
    rows = sample(120) + [(t, g, s) for _, t, g, s, _ in corpus(60)] + [(None, "en", "none"), ("", "xx", "s1"), (None, "xx", "s2")]
    assert run(spark, rows) == by_hand(rows)
    assert run(spark, rows, top=5) == by_hand(rows, top=5)


def test_small_blocks_and_a_joined_group_table(spark, monkeypatch):
    rows = sample(80, seed=5)
    monkeypatch.setattr(d, "_CELLS", 8)
    monkeypatch.setattr(d, "_SUMS", 1)
    monkeypatch.setattr(d, "_GROUPS", 0)
    monkeypatch.setattr(d, "_CHUNK", 200)
    assert run(spark, rows) == by_hand(rows)


def test_radix_order_is_a_stable_sort():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 500, dtype=np.uint64) >> np.uint64(40), rng.integers(0, 3, 500).astype(np.uint64)
    assert (d.radix_order([b, a]) == np.lexsort([a, b])).all()
    assert (d.radix_order([b]) == np.argsort(b, kind="stable")).all() and not len(d.radix_order([b[:0]]))


@pytest.mark.parametrize("length", [1, 7, 8])
def test_pack_keeps_the_bytes(length):
    data = np.frombuffer(b"zz" + b"abcdefgh"[:length], np.uint8)
    packed = d.pack(data, np.array([2, 2]), np.array([length, 0]))
    assert int(packed[0]).to_bytes(8, "big").rstrip(b"\0") == b"abcdefgh"[:length] and packed[1] == 0


def test_odd_rows_and_empty_tables(spark):
    got = {tuple(r) for r in d.divergence(odd(spark)).collect()}
    assert got == by_hand([(r["text"], r["lang"], r["source"]) for r in odd(spark).collect()]) and got
    assert d.divergence(empty(spark)).count() == 0
    none = spark.createDataFrame([(None, None, None)] * 4, "text string, lang string, source string")
    assert d.divergence(none).count() == 0
    assert SCHEMA  # the same columns as documents
