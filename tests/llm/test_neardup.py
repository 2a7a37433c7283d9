import random
import re

from florapark.llm import neardup as n
from texts import SCHEMA, corpus, empty, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def by_hand(rows, width=4, percent=80):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, base, n, most):
    """Copies of a text with up to ``most`` words exchanged, some words upper case, white space changed."""
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10_000)}"
        out.append("  ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return out


def compare(spark, rows, **kw):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()}
    assert got == by_hand(rows, kw.get("width", 5))


def test_components_equal_all_pairs(spark):
    rng = random.Random(8)
    texts = [t for _, t, *_ in corpus(60, seed=4)]
    # copies near the threshold, so that many are linked only through others and some not at all
    for k in range(4):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(100 + 20 * k))
        texts += family(rng, base, 40, 8)
    texts += ["", "one", "one", "two words", "two words", "TWO words", "a b c d", "a b c d e"]
    rng.shuffle(texts)
    compare(spark, list(enumerate(texts)), width=4)


def test_large_group_of_copies(spark):
    rng = random.Random(9)
    base = " ".join(f"w{k}" for k in range(80))
    compare(spark, list(enumerate(family(rng, base, 400, 10))), width=4)


def test_blocks_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(n, "_SIDE", 16)
    monkeypatch.setattr(n, "_DENSE", 50)
    rng = random.Random(10)
    base = " ".join(f"w{k}" for k in range(80))
    compare(spark, list(enumerate(family(rng, base, 120, 9))), width=4)


def test_posterior_floor():
    floor = n.least_matches(0.8, 1e-6)
    assert floor == sorted(floor) and 0.5 * 256 < floor[-1] < 0.8 * 256
    assert n.least_matches(0.8, 0.5)[-1] > floor[-1]


def test_odd_rows_and_empty_tables(spark):
    out = n.near_duplicates(odd(spark)).collect()
    assert len(out) == 11
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out}
    assert (900, 0, 900, True) in got and (907, 1, 907, True) in got and (908, 1, 907, False) in got and (None, 3, None, True) in got
    assert n.near_duplicates(empty(spark)).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    rows = [*corpus(30), (500, "a b c d e f g h", "en", "s", 15), (501, "A b c d e f g h", "en", "s", 15)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = n.stage(spark, docs, "")
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} >= {500} and out.where("doc_id = 501").count() == 0


def test_repeated_ids_with_different_texts(spark):
    rng = random.Random(21)
    w = [f"w{k}" for k in range(60)]
    a, b, c = "one two three four five six seven", " ".join(w), " ".join([*w[:-1], "other"])
    rows = [(3, a), (5, a), (5, b), (9, c), (12, "nothing like the others at all here"), (None, b)]
    rng.shuffle(rows)
    got = sorted(map(repr, ((r["doc_id"], r["component_id"], r["kept"]) for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(repr, [(3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False), (12, 12, True), (None, None, True)]))


def test_stage_drops_rows_and_not_ids(spark):
    w = " ".join(f"w{k}" for k in range(60))
    rows = [(3, "a b c d e f g", 1), (5, "a b c d e f g", 2), (5, w, 3), (9, w + " more", 4), (None, "x y z", 5), (None, "x y z", 6), (None, "p q r s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    out = n.stage(spark, docs, "")
    assert out.columns == docs.columns and out.schema == docs.schema
    kept = {r["row"] for r in out.collect()}
    assert {1, 3, 7} <= kept and len(kept) == 4 and kept & {5, 6}


def test_unrelated_sets_are_pruned_at_any_length():
    floor = n.least_matches(0.8, 1e-6)
    rng = n.np.random.default_rng(3)
    for size in (20, 100, 500, 1000, 5000):
        proofs = []
        for _ in range(40):
            sig = n.signature(rng.integers(1 << 63, size=size, dtype=n.np.uint64))
            proofs.append((n.mix(sig[n.BANDS * n.ROWS:].astype(n.np.uint64)) & n.np.uint64(255)).astype(n.np.uint8))
        x = n.np.stack(proofs)
        i, j = n.np.triu_indices(40, 1)
        assert not len(n._not_ruled_out(x, x, i, j, floor)), size
