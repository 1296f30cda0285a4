"""Removal of byte strings that stand in more than one place, by suffix sorting.

Every byte that a string of ``LENGTH`` bytes covers goes if the same string starts anywhere
else, in the same document or another. Texts are UTF-8 bytes; matches stay in a document.

Not every suffix is sorted. Each string of ``LENGTH`` bytes has an anchor, the substring of
``GRAM`` bytes with the least hash in it, so equal strings have equal anchors at the same
distance. Consecutive strings with one anchor are a stretch. Anchors that occur once are
done. Stretches equal in whole repeat in whole. What is left are stretches around the same
anchor that differ, as where a repeated passage begins and ends. Beside the anchor, each of
their strings has half of its other bytes before or behind it, so only those that share that
half as well are looked at, and decided by a deep-shallow sort of their suffixes, one of
each distinct stretch: multikey quicksort orders them by the first ``SHALLOW`` bytes, and blind tries order the groups that agree so far.

The stretches of an anchor are dealt into blocks of a bounded number. Each block is sorted
alone; strings that a block of several has once meet by a hash of 128 bits.

Defined results: a null text is empty; texts shorter than ``LENGTH`` keep all; rows equal in
id and text are repeats of each other like any others; a null id is an id of its own; other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions.columns import named
from pagesift.llm.texts import (
    BYTE_VALUES, INVERSE, mix, powers, prefix_hashes, slices, span_hashes,
)
from pagesift.sources.staging import stage

LENGTH = 200
GRAM = 64
SHALLOW = 32
BLOCK = 4096
TASK_STRETCHES = 4096


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(first, last, anchor, h, f, sides): stretches of string starts with a common anchor.

    ``h`` is a hash of the anchor's bytes, ``f`` of all bytes of the stretch and the
    anchor's place in it; ``sides`` packs 32-bit hashes of the anchor with the half before
    and with the half behind it. Of equal least substrings the first is the anchor.
    """
    n, none, half = len(data), np.zeros(0, np.int64), (length - gram) // 2
    starts_ok = np.zeros(n, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        starts_ok[a : max(a, b - length + 1)] = True
    at = np.flatnonzero(starts_ok)
    if not len(at):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    prefix = prefix_hashes(BYTE_VALUES[data])
    grams = n - gram + 1
    h = mix((prefix[gram:] - prefix[:grams]) * powers(INVERSE, grams))
    low = np.uint64((1 << int(n).bit_length()) - 1)
    width = length - gram + 1
    keys = np.full(-(-grams // width) * width, np.uint64(2**64 - 1))
    keys[:grams] = (h & ~low) | np.arange(grams, dtype=np.uint64)
    rows = keys.reshape(-1, width)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    before = np.minimum.accumulate(rows, axis=1).reshape(-1)
    anchor = (np.minimum(after[at], before[at + width - 1]) & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    anchor = anchor[new]
    f = mix(span_hashes(prefix, first, last + length) + (anchor - first).astype(np.uint64))
    before = span_hashes(prefix, np.maximum(anchor - half, 0), anchor + gram)
    behind = span_hashes(prefix, anchor, np.minimum(anchor + gram + half, n))
    low = np.uint64(2**32 - 1)
    return first, last, anchor, h[anchor], f, (before << np.uint64(32)) | (behind & low)


def _stretch_rows(length: int, gram: int):
    def rows(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, data, offsets in slices(batch.column(1)):
                first, last, anchor, h, f, sides = stretches(data, offsets, length, gram)
                doc = np.searchsorted(offsets, first, "right") - 1
                place = first - offsets[doc]
                packed = (place << 16) | ((last - first) << 8) | (anchor - first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)) for x in (h, f, keys[lo + doc], packed, sides)],
                    ["h", "f", "row", "at", "sides"],
                )

    return rows


def _spans(packed: np.ndarray, length: int) -> np.ndarray:
    first = packed >> 16
    return np.stack([first, first + ((packed >> 8) & 255) + length], axis=1)


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs that spans (start, end) cover."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    starts = np.flatnonzero(new)
    return np.stack([spans[starts, 0], reach[np.append(starts[1:] - 1, len(spans) - 1)]], axis=1)


def _result(data: bytes, spans: np.ndarray) -> tuple[int, int, int, str]:
    digest, last, gone = hashlib.sha256(), 0, 0
    for a, b in spans.tolist():
        digest.update(data[last:a])
        last, gone = b, gone + b - a
    digest.update(data[last:])
    return len(data), gone, len(spans), digest.hexdigest()


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _results(rows: list[tuple]) -> list[pa.Array]:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return [pa.array(c, t) for c, t in zip(columns, types, strict=True)]


def _texts(column: pa.Array):
    for x in column:
        yield b"" if x.as_py() is None else x.as_py().encode("utf-8", "surrogatepass")


def _decide(length: int):
    """Results of documents without open stretches; the others keep text and known spans."""

    def decide(batches):
        for batch in batches:
            known = batch.column("known").to_pylist()
            opened = batch.column("opened").is_valid().to_pylist()
            rows, spans = [], []
            for data, k, later in zip(_texts(batch.column("text")), known, opened, strict=True):
                own = merged(_spans(np.array(k or [], np.int64), length))
                spans.append(own.reshape(-1) if later else None)
                rows.append((None,) * 4 if later else _result(data, own))
            text = pa.array(
                [t if o else None for t, o in zip(batch.column("text"), opened, strict=True)],
                batch.column("text").type,
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), text, batch.column("opened"),
                 pa.array(spans, pa.list_(pa.int64())), *_results(rows)],
                ["id", "row", "text", "opened", "spans", *RESULT_NAMES],
            )

    return decide


def _finish():
    def finish(batches):
        for batch in batches:
            rows = []
            for data, known, found in zip(
                _texts(batch.column("text")), batch.column("spans").to_pylist(),
                batch.column("found").to_pylist(), strict=True,
            ):
                spans = np.array(known + (found or []), np.int64).reshape(-1, 2)
                rows.append(_result(data, merged(spans)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *_results(rows)], ["id", *RESULT_NAMES]
            )

    return finish


def _cut(length: int):
    """The bytes of the open stretches."""

    def cut(batches):
        for batch in batches:
            for row, data, opened in zip(
                batch.column("row").to_pylist(), _texts(batch.column("text")),
                batch.column("opened").to_pylist(), strict=True,
            ):
                packed = np.array([o["at"] for o in opened], np.int64)
                bytes_ = [data[a:b] for a, b in _spans(packed, length).tolist()]
                columns = {k: [o[k] for o in opened] for k in ("h", "f", "n", "size", "at")}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(opened), pa.int64()),
                     *[pa.array(c, pa.int64()) for c in columns.values()],
                     pa.array(bytes_, pa.binary())],
                    ["row", *columns, "bytes"],
                )

    return cut


def deep_shallow(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the classes of equal ``length``-byte suffixes, within each group.

    Suffixes that differ from all others of their group have the class -1. All groups are
    sorted at once: each level of the quicksort takes eight more bytes as one key, and the
    suffixes that are equal in them form the groups of the next level. Beyond the shallow
    depth each level of the tries takes the first suffix of a group as the path of a node
    and finds where the others leave it; those that leave at the same depth with the same
    byte hang there and are the groups of the next level.
    """
    out = np.full(len(start), -1, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    rest, made = np.arange(len(start)), 0

    def regroup(keys: list[np.ndarray], members: np.ndarray):
        """Sorts members by keys; those alone in theirs are dropped."""
        order = np.lexsort(keys[::-1])
        change = np.zeros(len(order), bool)
        change[:1] = True
        for k in keys:
            change[1:] |= k[order][1:] != k[order][:-1]
        number = np.cumsum(change) - 1
        shared = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
        return members[order][shared], number[shared]

    rest, own = regroup([group], rest)
    for depth in range(0, min(SHALLOW, length), 8):
        at = start[rest] + depth
        key = np.zeros(len(rest), np.uint64)
        for k in range(min(8, length - depth)):
            key = (key << np.uint64(8)) | padded[at + k]
        rest, own = regroup([own, key], rest)
    while len(rest):
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        leader = rest[head][np.cumsum(np.append(False, own[1:] != own[:-1]))]
        leaves = np.full(len(rest), length, np.int64)
        for lo in range(0, len(rest), 1 << 15):
            part = slice(lo, lo + (1 << 15))
            places = np.arange(min(SHALLOW, length), length)
            differ = data[start[rest[part]][:, None] + places] != data[
                start[leader[part]][:, None] + places
            ]
            some = differ.any(1)
            leaves[part][some] = differ.argmax(1)[some] + min(SHALLOW, length)
        same = leaves == length
        count = np.bincount(own, same)[own]
        equal = same & (count > 1)
        out[rest[equal]] = made + own[equal]
        made += int(own[-1]) + 1
        rest, own, leaves = rest[~same], own[~same], leaves[~same]
        byte = data[start[rest] + leaves]
        rest, own = regroup([own, leaves, byte], rest)
    return out


DECIDED = "row long, first long, last long, w1 long, w2 long"


def _sort_block(length: int, block: int):
    def sort(key, table):
        packed, h = table["at"].to_numpy(), table["h"].to_numpy()
        copies, size = table["n"].to_numpy(), table["size"].to_numpy()
        row = table["row"].to_numpy()
        column = table["bytes"].combine_chunks()
        off = column.buffers()[1]
        off = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)
        count = ((packed >> 8) & 255) + 1
        stretch = np.repeat(np.arange(len(packed)), count)
        step = np.arange(len(stretch)) - np.repeat(np.cumsum(count) - count, count)
        start = off[:-1].astype(np.int64)[stretch] + step
        # Equal strings have the anchor at the same distance.
        away = ((packed[stretch] & 255) - step).astype(np.uint64)
        group = mix(h.view(np.uint64)[stretch] + away).view(np.int64)
        classes = deep_shallow(data, start, group, length)
        place = (packed >> 16)[stretch] + step
        dup = (classes >= 0) & (copies[stretch] == 1)
        # Consecutive starts of a stretch make one span.
        at = np.flatnonzero(dup)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (stretch[at[1:]] != stretch[at[:-1]])
        begin = at[new]
        end = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] if len(at) else at
        none = pa.nulls(len(begin), pa.int64())
        parts = [pa.table(
            [pa.array(row[stretch[begin]]), pa.array(place[begin]), pa.array(place[end] + length),
             none, none], ["row", "first", "last", "w1", "w2"],
        )]
        # Of anchors with more blocks each string goes on once, without a place if decided.
        alone = (classes < 0) & (size[stretch] > block)
        lead = np.zeros(len(classes), bool)
        lead[np.unique(classes, return_index=True)[1]] = True
        lead &= (classes >= 0) & (size[stretch] > block)
        go = np.flatnonzero(alone | lead)
        if len(go):
            open_ = alone[go] & (copies[stretch[go]] == 1)
            w = []
            for base in (BYTE_VALUES, mix(BYTE_VALUES) | np.uint64(1)):
                prefix = prefix_hashes(base[data])
                w.append(span_hashes(prefix, start[go], start[go] + length).view(np.int64))
            parts.append(pa.table(
                [pa.array(row[stretch[go]], mask=~open_), pa.array(place[go], mask=~open_),
                 pa.array(place[go] + length, mask=~open_), pa.array(w[0]), pa.array(w[1])],
                ["row", "first", "last", "w1", "w2"],
            ))
        return pa.concat_tables(parts)

    return sort


def _halves(kinds: DataFrame, half: int) -> DataFrame:
    """(h, f, n, row, at): stretches cut where the longer rest of their strings changes sides.

    ``h`` then stands for the anchor with the half before or behind it.
    """
    at, sides = F.col("one.at"), F.col("one.sides")
    first, more = F.shiftright(at, 16), F.shiftright(at, 8).bitwiseAND(F.lit(255))
    away = at.bitwiseAND(F.lit(255))

    def part(side: int, key, skip, size, ok):
        packed = F.shiftleft(first + skip, 16) + F.shiftleft(size, 8) + (away - skip)
        return F.when(
            ok, F.struct(F.xxhash64("h", F.lit(side), key).alias("h"), packed.alias("at"))
        )

    zero = F.lit(0).cast("long")
    skip = F.greatest(away - (half - 1), zero)
    parts = F.array(
        part(0, F.shiftrightunsigned(sides, 32), zero, F.least(more, away - half), away >= half),
        part(1, sides.bitwiseAND(F.lit(2**32 - 1)), skip, more - skip, more >= skip),
    )
    cut = kinds.select("f", "n", F.col("one.row").alias("row"), F.explode(parts).alias("part"))
    return cut.where(F.col("part").isNotNull()).select("part.h", "f", "n", "row", "part.at")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    gram: int = GRAM, block: int = BLOCK,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    if not 8 <= gram < length <= gram + 255:
        raise ValueError("the anchor's length must be at most 255 below the strings' length")
    doc, text = named([id_col, text_col])
    texts = docs.select(doc.alias("id"), text.alias("text"), F.xxhash64(doc, text).alias("row"))
    found = stage(
        texts.where(F.octet_length("text") >= length).select("row", "text")
        .mapInArrow(_stretch_rows(length, gram), "h long, f long, row long, at long, sides long"),
        "suffix-stretches",
    )
    often = stage(
        found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"),
        "suffix-anchors",
    )
    near = stage(found.join(often, "h"), "suffix-near")
    kinds = stage(
        near.groupBy("h", "f").agg(
            F.count("*").alias("n"), F.min(F.struct("row", "at", "sides")).alias("one")
        ),
        "suffix-kinds",
    )
    several = stage(
        kinds.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"),
        "suffix-several",
    )
    halves = stage(_halves(kinds.join(several, "h"), (length - gram) // 2), "suffix-halves")
    mixed = stage(
        halves.groupBy("h").agg(F.count("*").alias("size")).where("size > 1"), "suffix-mixed"
    )
    # One stretch of each kind stands for all in the sort; kinds of several repeat in whole.
    many = stage(kinds.where("n > 1").select("h", "f"), "suffix-whole")
    known = near.join(many, ["h", "f"]).groupBy("row").agg(F.collect_set("at").alias("known"))
    opened = halves.join(mixed, "h").groupBy("row").agg(
        F.collect_list(F.struct("h", "f", "n", "size", "at")).alias("opened")
    )
    marks = stage(known.join(opened, "row", "full"), "suffix-marks")
    first = stage(
        texts.join(marks, "row", "left").mapInArrow(
            _decide(length),
            f"id {texts.schema['id'].dataType.simpleString()}, row long, text string, "
            "opened array<struct<h:long,f:long,n:long,size:long,at:long>>, spans array<long>, "
            + RESULT,
        ),
        "suffix-first",
    )
    pending = first.where(F.col("opened").isNotNull())
    cut = pending.select("row", "text", "opened").mapInArrow(
        _cut(length),
        "row long, h long, f long, n long, size long, at long, bytes binary",
    )
    total = mixed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // TASK_STRETCHES))
    own = F.pmod(F.col("f"), F.ceil(F.col("size") / F.lit(block)))
    task = F.when(F.col("size") <= block, F.pmod(F.col("h"), F.lit(tasks))).otherwise(
        F.xxhash64("h", own)
    )
    sorted_ = stage(
        cut.groupBy(task.alias("task")).applyInArrow(_sort_block(length, block), DECIDED),
        "suffix-sorted",
    )
    single = sorted_.where(F.col("w1").isNotNull())
    twice = stage(
        single.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"),
        "suffix-twice",
    )
    spans = sorted_.where(F.col("w1").isNull()).select("row", "first", "last").unionByName(
        single.where(F.col("row").isNotNull()).join(twice, ["w1", "w2"])
        .select("row", "first", "last")
    )
    of_row = spans.groupBy("row").agg(
        F.flatten(F.collect_set(F.array("first", "last"))).alias("found")
    )
    rest = pending.select("id", "row", "text", "spans").join(of_row, "row", "left").select(
        "id", "text", "spans", "found"
    ).mapInArrow(_finish(), f"id {texts.schema['id'].dataType.simpleString()}, {RESULT}")
    done = first.where(F.col("opened").isNull()).select("id", *RESULT_NAMES)
    return done.unionByName(rest)
