import random
import re

import numpy as np
import xxhash
from florapark.llm import simhash as s
from pyspark.sql import functions as F
from texts import corpus, empty, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def print_of(text, width=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[k:k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(items, bits=3):
    """Smallest label reachable of (label, fingerprint) items, by all pairs; items with one label are linked."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(items):
        for j, (b, y) in enumerate(items[:i]):
            if (x ^ y).bit_count() <= bits or (a == b and a is not None):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (a, _) in enumerate(items):
        if a is not None:
            least[find(i)] = min(a, least.get(find(i), a))
    return [least.get(find(i)) for i in range(len(items))]


def texts(seed):
    rng = random.Random(seed)
    out = [t for _, t, *_ in corpus(60, seed=seed)]
    for k in range(4):
        base = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(9)}"
            out.append("  ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return out + ["", None, " \n", "one", "One", "two words", "a b c", "é É x"]


def test_components_equal_all_pairs(spark):
    rows = list(enumerate(texts(4)))
    random.Random(1).shuffle(rows)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = [(i, print_of(t)) for i, t in rows]
    assert got == {i: (f"{p:016x}", c) for (i, p), c in zip(prints, components(prints))}
    assert 1 < len({c for _, c in got.values()}) < len({p for p, _ in got.values()})


def test_repeated_ids_with_different_texts(spark):
    rows = [(3, "a b c d"), (5, "a b c d"), (5, "p q r s t u"), (9, "P q r s t u"), (None, "p q r s t u"), (None, "x y z"), (5, "k l m n")]
    got = sorted(map(repr, s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()))
    items = [(i, print_of(t)) for i, t in rows]
    assert got == sorted(f"Row(doc_id={i}, component_id={c})" for (i, _), c in zip(items, components(items)))


def link_all(spark, values, bits):
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in s.near_pairs(df, bits).collect()]
    assert all((a ^ b).bit_count() <= bits for a, b in pairs)
    place = {v: i for i, v in enumerate(values)}
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(place[a]), find(place[b])
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def balls(seed, n, most):
    rng = random.Random(seed)
    out = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(n):
            v = c
            for b in rng.sample(range(64), rng.randint(0, most)):
                v ^= 1 << b
            out.add(v)
    return sorted(out)


def test_every_number_of_bits(spark):
    for bits in (0, 1, 2, 3, 4):
        values = balls(bits, 40, bits + 1)
        assert link_all(spark, values, bits) == components(list(enumerate(values)), bits)


def test_large_variants_are_indexed_again(spark, monkeypatch):
    rng = random.Random(3)
    low = rng.getrandbits(32)
    # one half the same everywhere, so that its variants hold all of them
    values = sorted({low | (rng.choice([1, 2, 3]) << 40 | rng.getrandbits(32) & rng.getrandbits(32) & rng.getrandbits(32)) << 32 & ((1 << 64) - 1) for _ in range(500)})
    monkeypatch.setattr(s, "LIMIT", 40)
    assert link_all(spark, values, 3) == components(list(enumerate(values)))


def test_masks_leave_no_near_pair_apart():
    rng = random.Random(7)
    for bits in (1, 2, 3, 5):
        masks = s.variant_masks(bits)
        for _ in range(200):
            x = y = rng.getrandbits(64)
            for b in rng.sample(range(64), bits):
                y ^= 1 << b
            shared = [m for m in masks if (x & m) % (1 << 64) == (y & m) % (1 << 64)]
            assert shared
            assert any((x ^ y) & m % (1 << 64) == 0 for m in s.finer_masks(shared[0], bits))


def test_odd_rows_and_empty_tables(spark):
    out = s.near_duplicates(odd(spark)).collect()
    rows = [(r["doc_id"], print_of(r["text"])) for r in odd(spark).collect()]
    assert sorted(map(repr, ((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out))) == sorted(
        repr((i, f"{p:016x}", c)) for (i, p), c in zip(rows, components(rows)))
    assert s.near_duplicates(empty(spark)).count() == 0


def test_hash_is_that_of_the_columns(spark):
    row = spark.createDataFrame([("grün b c",)], "t string").select(F.xxhash64("t").alias("h"), s.as_text(F.xxhash64("t")).alias("x")).first()
    assert row["h"] % (1 << 64) == s.fingerprint("grün b c".encode()) and row["x"] == f"{row['h'] % (1 << 64):016x}"
