"""Numpy passes over the UTF-8 bytes of many texts at once: words, their hashes, byte n-grams.

All functions work on a chunk: whole texts joined by a line feed, about ``CHUNK``
bytes, so that memory follows the chunk and the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_PIECE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _INVERSE = _powers(_P, _PIECE + 1), _powers(_P_INVERSE, _PIECE + 1)

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLDED = _VALUE[_LOWER]

# for bags of words: ASCII that is neither letter nor digit also ends a word
NOT_WORD = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, end row, joined bytes, byte offset of each text and of the end) for runs of whole texts; null is empty."""
    whole = [b"" if t is None else t for t in texts.cast(pa.large_binary()).to_pylist()]
    first, held = 0, 0
    for i, t in enumerate(whole):
        held += len(t) + 1
        if held >= size or i + 1 == len(whole):
            part = whole[first:i + 1]
            offsets = np.zeros(len(part) + 1, np.int64)
            np.cumsum([len(x) + 1 for x in part], out=offsets[1:])
            yield first, i + 1, b"\n".join(part) + b"\n", offsets
            first, held = i + 1, 0


def word_spans(data: np.ndarray, ends_word: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte start and end of each word; ``data`` ends with a byte that ends a word."""
    gap = ends_word[data]
    before = np.empty_like(gap)
    before[0], before[1:] = True, gap[:-1]
    return np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each span, of its bytes alone; ``fold`` takes A-Z as a-z. Works through the bytes in pieces."""
    value = _FOLDED if fold else _VALUE
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        # at least one word; spans longer than a piece are hashed block by block below
        upto = max(at + 1, int(np.searchsorted(ends, low + _PIECE, "right")))
        high = ends[upto - 1]
        if high - low > _PIECE:
            out[at] = _long_hash(value, data[low:high])
        else:
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(value[data[low:high]] * _POWER[:high - low], out=sums[1:])
            a, b = starts[at:upto] - low, ends[at:upto] - low
            out[at:upto] = (sums[b] - sums[a]) * _INVERSE[a]
        at = upto
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(_P))


def _long_hash(value: np.ndarray, data: np.ndarray) -> np.uint64:
    total, scale = 0, 1
    for k in range(0, len(data), _PIECE):
        part = data[k:k + _PIECE]
        total += int((value[part] * _POWER[:len(part)]).sum(dtype=np.uint64)) * scale
        scale = scale * int(_POWER[_PIECE]) % (1 << 64)
    return np.uint64(total % (1 << 64))


def row_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which text of the chunk each byte position lies in."""
    return np.searchsorted(offsets, starts, "right") - 1


def segment_sums(values: np.ndarray, segment: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` per segment number."""
    return np.bincount(segment, weights=values, minlength=n)
