"""Packing of tokenized documents into sequences of a fixed length.

Every document is cut into full sequences and one rest. A full sequence stands alone;
the rests are packed by first-fit decreasing inside randomised groups of documents,
each group on its own: a tournament tree over the free room of the group's bins finds
the first bin with enough room in logarithmic time. A group holds ``GROUP`` documents
on average, so no group grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from florapark.llm._bytes import SPACE, chunks, word_hashes
from florapark.llm._store import pin, ship

LENGTH = 1024
GROUP = 2048
END_ID = 0
_CACHE_LIMIT = 1_500_000  # tokenized pieces of text that a worker remembers

_ALNUM = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
_MARK = np.array([c < 128 and chr(c).isprintable() and not chr(c).isalnum() and c not in (32, 39) for c in range(256)])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _odd_space(data: np.ndarray) -> np.ndarray:
    """Positions of white space other than the six ASCII characters."""
    a, b, c = data, np.r_[data[1:], 0], np.r_[data[2:], 0, 0]
    return np.flatnonzero(
        ((a >= 28) & (a <= 31)) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0)))
        | ((a == 0xE2) & ((b == 0x80) | (b == 0x81)) & (((c >= 0x80) & (c <= 0x8B)) | (c >= 0xA8) | (c == 0x9F)))
        | ((a == 0xE3) & (b == 0x80) & (c == 0x80)))


class Encoder:
    """Token ids of whole texts, put together from remembered ids of their pieces.

    The tokenizer splits a text at white space and between letters and marks before it
    merges anything, so a text may be cut before a run of white space, and between an
    ASCII letter or digit and an ASCII mark other than the apostrophe. Texts with white
    space beyond ASCII are encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of pieces
        self.place = np.zeros(0, np.int64)  # and their numbers
        # piece 0 is the end of a document
        self.ids = np.full(1 << 16, END_ID, np.uint32)
        self.used = 1
        self.first, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)

    def _learn(self, data: bytes, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        texts = [data[a:b].decode("utf-8") for a, b in zip(starts.tolist(), ends.tolist())]
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.array([len(x) for x in lists], np.int64)
        flat = np.fromiter((i for x in lists for i in x), np.uint32, int(size.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(len(self.ids), np.uint32)]
        self.ids[self.used:self.used + len(flat)] = flat
        number = len(self.first) + np.arange(len(keys))
        self.first = np.r_[self.first, self.used + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, number)

    def encode(self, part: bytes, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a chunk, the end id last."""
        data = np.frombuffer(part, np.uint8)
        gap = SPACE[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = (gap[1:] & ~gap[:-1]) | (_MARK[data[1:]] & _ALNUM[data[:-1]])
        end = offsets[1:] - 1  # the line feed after each text
        cut[offsets[:-1]] = True
        cut[end] = True
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], len(data)]
        keys = word_hashes(data, starts, ends, fold=False)
        is_end = np.zeros(len(data), bool)
        is_end[end] = True
        is_end = is_end[starts]
        odd = np.unique(np.searchsorted(offsets, _odd_space(data), "right") - 1)
        if len(self.keys) > _CACHE_LIMIT:
            self._reset()
        some, at, back = np.unique(keys, return_index=True, return_inverse=True)
        pos = np.searchsorted(self.keys, some)
        known = pos < len(self.keys)
        known[known] = self.keys[pos[known]] == some[known]
        if not known.all():
            new = ~known
            self._learn(part, some[new], starts[at[new]], ends[at[new]])
            pos = np.searchsorted(self.keys, some)
        piece = np.where(is_end, 0, self.place[pos][back])
        size = self.size[piece]
        upto = np.cumsum(size)
        flat = self.ids[np.repeat(self.first[piece] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
        last = upto[is_end]
        out = np.split(flat, last[:-1])
        for i in odd:
            text = part[offsets[i]:end[i]].decode("utf-8")
            out[i] = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END_ID], np.uint32)
        return out


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full sequences of each text and its rest. Null texts are empty."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        path = tokenizer or default_tokenizer()
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        for batch in batches:
            ids = batch.column("doc_id")
            for row, _, part, offsets in chunks(batch.column("text")):
                whole = _ENCODERS[path].encode(part, offsets)
                at, start, size, crc, total = [], [], [], [], []
                for i, x in enumerate(whole):
                    raw = memoryview(np.ascontiguousarray(x, dtype="<u4")).cast("B")
                    for a in range(0, len(x), length):
                        b = min(a + length, len(x))
                        at.append(row + i), start.append(a), size.append(b - a), total.append(len(x))
                        crc.append(zlib.crc32(raw[4 * a:4 * b]))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at, pa.int64())), *(pa.array(v, pa.int64()) for v in (start, size, crc, total))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item, items taken by falling size; ``tree`` holds the most room below each node."""
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        need, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        where[i], offset[i] = node - leaves, capacity - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a > b else b
            node //= 2
    return where, offset


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece of ``docs`` (doc_id, text).

    A null or empty text is its end id alone. Rows without doc_id and rows with equal
    doc_id are packed like any others. Other columns are not read. Groups are drawn by
    a hash of the piece's number, so that rows that repeat are spread over all groups.
    """
    cut = pin(pieces(docs, tokenizer, length).withColumn("_row", F.monotonically_increasing_id()))
    full, rest = cut.where(F.col("length") == length), cut.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def fill(f):
        f = f.sort_values(["length", "ids_crc32", "_row"], ascending=[False, True, True], ignore_index=True)
        where, offset = first_fit_decreasing(f["length"].to_numpy(), length)
        # even numbers: packed bins; odd numbers: full sequences
        return f.drop(columns=["_group", "_row"]).assign(
            sequence_id=2 * ((f["_group"].to_numpy() << 24) + where), offset=offset)

    drawn = rest.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(2)), F.lit(groups)))
    packed = drawn.groupBy("_group").applyInPandas(
        fill, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    alone = full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                        (2 * F.col("_row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(packed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences of 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what the mixture kept."""
    return pack(docs)
