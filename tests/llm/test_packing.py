import random
import zlib

import numpy as np
import pytest
from florapark.llm import packing as p
from florapark.llm._bytes import chunks
from hypothesis import given, settings, strategies as st
from texts import SCHEMA, corpus, empty, odd


@pytest.fixture(scope="module")
def encoder():
    return p.Encoder(p.default_tokenizer())


def ids_of(encoder, text):
    return [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


PARTS = ["a", "word", "don't", "'s", "'", " ", "  ", "\n", "\t", ".", "!!", "--", "é", "—", "\xa0", "　", " ", "\x1c", "12", "😀", "<|endoftext|>", "_"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=1, max_size=6))
def test_ids_equal_those_of_the_tokenizer(texts):
    import pyarrow as pa

    encoder = test_ids_equal_those_of_the_tokenizer.__dict__.setdefault("e", p.Encoder(p.default_tokenizer()))
    got = [x for _, _, part, offsets in chunks(pa.array(texts)) for x in encoder.encode(part, offsets)]
    assert [list(x) for x in got] == [ids_of(encoder, t) for t in texts]


def test_first_fit_decreasing_equals_a_plain_scan():
    rng = random.Random(2)
    for n in (1, 2, 7, 100):
        sizes = np.array([rng.randint(1, 64) for _ in range(n)])
        room, where = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            if k == len(room):
                room.append(64)
            where[int(i)] = (k, 64 - room[k])
            room[k] -= sizes[i]
        bins, offsets = p.first_fit_decreasing(sizes, 64)
        assert {i: (int(bins[i]), int(offsets[i])) for i in range(n)} == where


def check(rows, docs, encoder, length):
    ids = {}
    for r in docs:
        ids.setdefault(r["doc_id"], []).append(np.array(ids_of(encoder, r["text"]), "<u4"))
    covered = {}
    for r in rows:
        fit = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"]
               and zlib.crc32(x[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]]
        assert fit
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
    assert covered == {k: sum(map(len, v)) for k, v in ids.items()}
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return by_sequence


def test_every_id_lies_in_one_piece(spark, encoder):
    docs = spark.createDataFrame(corpus(150), SCHEMA)
    sequences = check(p.pack(docs, length=64, group=40).collect(), docs.collect(), encoder, 64)
    used = sum(n for s in sequences.values() for _, n in s)
    assert used / (64 * len(sequences)) > 0.95


def test_odd_rows_and_empty_tables(spark, encoder):
    check(p.pack(odd(spark)).collect(), odd(spark).collect(), encoder, 1024)
    assert p.pack(empty(spark)).count() == 0


def test_repeated_rows_are_spread_over_groups(spark):
    rows = [(7, "the same text over and over")] * 3000
    out = p.pack(spark.createDataFrame(rows, "doc_id long, text string"), group=300)
    groups = out.selectExpr("sequence_id >> 25 AS g").groupBy("g").count().collect()
    assert len(groups) == 10 and max(r["count"] for r in groups) < 450
