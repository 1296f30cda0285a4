"""Whole texts of Arrow batches as numpy arrays, and hashes of the words in them.

The functions here see one slice of a batch at a time: as many whole documents as fit in
``SLICE_BYTES``, or one longer document alone, so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_VALUES = BYTE_VALUES[LOWER]
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
NGRAM = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(
    texts: pa.Array, limit: int = SLICE_BYTES
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; a null text is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32) if offsets else np.zeros(1, int)
    off = off[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, len(texts))
        yield lo, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 … base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, np.uint64(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hashes`` takes the hash of any span."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end): equal contents have equal hashes wherever they are."""
    return mix((prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start])


_BYTES_LEFT = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
LONG_WORD = 32


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), eight bytes at a time and each step mixed, so that
    no rule makes two words meet; words over ``LONG_WORD`` bytes are hashed one by one."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    size = end - start
    out = mix(size.astype(np.uint64))
    own = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        own = own[size[own] > at]
        if not len(own):
            break
        chunk = eight[start[own] + at] & _BYTES_LEFT[np.minimum(size[own] - at, 8)]
        out[own] = mix(out[own] ^ chunk)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Starts and ends of the words of each document and the documents they are in.

    ``is_word`` tells for each of the 256 byte values whether it belongs to words.
    """
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] |= inside[1:-1][cut]
    ends[cut - 1] |= inside[1:-1][cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, n: int
) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each document.

    A document of fewer words has its whole sequence as the only one; one without words
    has none. A-Z count as a-z.
    """
    start, end, doc = words(data, offsets, is_word)
    h = word_hashes(LOWER[data], start, end)
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    count = np.diff(bounds)
    m = max(0, len(h) - n + 1)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total += h[j : j + m] * NGRAM[j]
    total = mix(total)
    out = []
    for i, c in enumerate(count):
        a = bounds[i]
        if c >= n:
            out.append(np.unique(total[a : a + c - n + 1]))
        elif c:
            few = np.sum(h[a : a + c] * NGRAM[8 : 8 + c], keepdims=True, dtype=np.uint64)
            out.append(mix(few + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` for columns of any name: ``fn`` goes by place."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(fn, schema)


def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of an Arrow column of lists without nulls as numpy arrays."""
    out = []
    for chunk in column.chunks:
        values, off = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
    return out
