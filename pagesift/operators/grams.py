"""Where texts may hold one of many patterns: stretches of bytes and a filter of bounded size.

A pattern is listed under the hash of one of its stretches. The hashes of all listed stretches
make a Bloom filter of at most ``MOST_BITS`` bits, which every task has; the texts are hashed at
each byte, and only the places that pass the filter leave the task, each with the bytes
around it. What passes is joined with the list and compared there, so the filter's size
and its errors change the speed, never the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

LEAST_BITS, MOST_BITS = 15, 27  # powers of two
BITS_EACH, PROBES = 32, 4
CHUNK = 1 << 20  # bytes that are hashed at a time
STEP = 1 << 15  # the same where several sizes are hashed: what fits a core's cache
PART = 1 << 15  # bits of one row of ``bitmap_construct_agg``
_BASE = 0x9E3779B97F4A7C15
_ODD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_ODD[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_ODD[1])
    return h ^ (h >> np.uint64(31))


def _rolled(data: np.ndarray, size: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """A number for every stretch of ``size`` bytes, from those of shorter stretches."""
    if size not in known:
        if size == 1:
            known[1] = data.astype(np.uint64) + np.uint64(1)
        else:
            left = 1 << ((size - 1).bit_length() - 1)
            first, rest = _rolled(data, left, known), _rolled(data, size - left, known)
            n = max(len(data) - size + 1, 0)
            known[size] = first[:n] * np.uint64(pow(_BASE, size - left, 1 << 64)) + rest[left : left + n]
    return known[size]


def _probe(h: np.ndarray, odd: int, bits: int) -> np.ndarray:
    return (h * np.uint64(odd)) >> np.uint64(64 - bits)


def _passed(h: np.ndarray, place: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = (8 * len(bitmap)).bit_length() - 1
    for odd in _ODD[:PROBES]:
        at = _probe(h, odd, bits).view(np.int64)
        hit = np.flatnonzero((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        h, place = h[hit], place[hit]
    return h, place


def bitmap_of(h: np.ndarray) -> np.ndarray:
    """The filter that ``gram_filter`` makes, of hashes at hand."""
    bits = min(max((len(h) * BITS_EACH).bit_length(), LEAST_BITS), MOST_BITS)
    flags = np.zeros(1 << bits, np.uint8)
    for odd in _ODD[:PROBES]:
        flags[_probe(h, odd, bits)] = 1
    return np.packbits(flags, bitorder="little")


def grams_of(
    values: np.ndarray, sizes: Sequence[int], told: Mapping[int, np.ndarray] | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sizes with places in ``values`` and hashes of the stretches that the size's filter passes, or
    of all, ``STEP`` places at a time; the texts' ends are not minded."""
    for start in range(0, len(values), STEP):
        known: dict[int, np.ndarray] = {}
        data = values[start : start + STEP + max(sizes, default=1) - 1]
        for size in sizes:
            h = _mixed(_rolled(data, size, known)[:STEP] + np.uint64(size))
            place = np.arange(start, start + len(h))
            if told is not None:
                h, place = _passed(h, place, told[size])
            if len(h):
                yield size, place, h


def texts_of(batch: pa.RecordBatch, name: str = "_text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a column of texts, one behind the other, and where each starts and ends."""
    texts = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        none = np.zeros(len(texts), np.int64)
        return np.zeros(0, np.uint8), none, none
    values = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return values, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def _places(
    values: np.ndarray, ends: np.ndarray, scopes: np.ndarray | None, size: int, told: bytes | None,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, places in ``values`` and hashes of the stretches that pass the filter."""
    bitmap = None if told is None else np.frombuffer(told, np.uint8)
    for start in range(0, len(values) - size + 1, CHUNK):
        h = _rolled(values[start : start + CHUNK + size - 1], size, {}) + np.uint64(size)
        place = np.arange(start, start + len(h))
        if scopes is not None:
            first, last = np.searchsorted(ends, [start, start + len(h) - 1], side="right")
            cuts = np.minimum(ends[first : last + 1], start + len(h))
            h = h ^ np.repeat(scopes[first : last + 1], np.diff(cuts, prepend=start))
        h = _mixed(h)
        if bitmap is not None:
            h, place = _passed(h, place, bitmap)
        row = np.searchsorted(ends, place, side="right")
        whole = place + size <= ends[row]
        if whole.any():
            yield row[whole], place[whole], h[whole]


def _mapper(
    names: Sequence[str], reach: Mapping[int, tuple[int, int]], scoped: bool, told: bytes | None,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``reach`` has, for each size, the bytes before and from the place that go with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, starts, ends = texts_of(batch)
            if not len(values):
                continue
            scopes = None
            if scoped:
                scopes = batch.column(batch.schema.get_field_index("_scope")).to_numpy(zero_copy_only=False)
                scopes = scopes.astype(np.int64).view(np.uint64)
            raw = values.tobytes()
            for size, (before, behind) in reach.items():
                for row, place, h in _places(values, ends, scopes, size, told):
                    lo, hi = np.maximum(place - before, starts[row]), np.minimum(place + behind, ends[row])
                    around = [raw[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                    once = {k: i for i, k in enumerate(zip(row.tolist(), h.tolist(), around, strict=True))}
                    own = np.fromiter(once.values(), np.int64, len(once))
                    kept = batch.select(list(names)).take(pa.array(row[own]))
                    yield pa.RecordBatch.from_arrays(
                        [*kept.columns, pa.array(h[own].view(np.int64)),
                         pa.array([around[i] for i in own.tolist()], pa.binary())],
                        names=[*names, "_gram", "_around"],
                    )

    return run


def gram_places(
    df: DataFrame, names: Sequence[str], reach: Mapping[int, tuple[int, int]],
    scoped: bool = False, told: bytes | None = None,
) -> DataFrame:
    """``(*names, _gram, _around)`` for stretches of ``df._text`` (binary) that ``told`` may hold,
    or for all; of a row's equal ones, one. ``df._scope`` (long), if asked for, parts equal
    stretches of rows that have nothing to do with each other."""
    fields = [df.schema[n] for n in names]
    schema = StructType([*fields, StructField("_gram", LongType()), StructField("_around", BinaryType())])
    wanted = [*names, *(["_scope"] if scoped else []), "_text"]
    return df.select(*wanted).mapInArrow(_mapper(names, reach, scoped, told), schema)


def gram_filter(grams: DataFrame) -> bytes:
    """The Bloom filter of ``grams._gram``: read twice, and at most 16 MB come to the driver."""
    n = grams.count()
    bits = min(max((n * BITS_EACH).bit_length(), LEAST_BITS), MOST_BITS)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.unique(np.concatenate([_probe(h, odd, bits) for odd in _ODD[:PROBES]])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    at = grams.select("_gram").mapInArrow(probes, "at long")
    parts = (
        at.groupBy(F.expr(f"at div {PART}").alias("part"))
        .agg(F.bitmap_construct_agg(F.col("at") % PART).alias("bits"))
    )
    out = bytearray((1 << bits) // 8)
    size = PART // 8
    for row in parts.collect():
        out[row.part * size : (row.part + 1) * size] = row.bits
    return bytes(out)
