"""Packing of tokenised texts into windows of a fixed number of tokens.

Bounded-space online packing: each partition keeps a fixed number of open windows. Whole
windows are cut off a document first; the rest goes, uncut, to the open window that it
leaves the least room in; where none has the room, a new window is opened, and once all are
open the fullest is emitted for it. What is open at the end of the partitions is merged:
the pieces in the open windows of up to ``FAN`` partitions are packed again, largest first,
until one task has packed the last.

Defined results: a null or empty text is the end token alone; every document has at least
one piece; repeated rows and repeated ids are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions.columns import named
from pagesift.sources.staging import stage

WINDOW = 1024
OPEN_WINDOWS = 128
FAN = 64
END = 0
BATCH = 64

PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, closed boolean, part long"
)
NAMES = [x.split()[0] for x in PIECE.split(", ")]


def load_tokenizer(path: str | None = None) -> Callable[[str], list[int]]:
    """Token ids of a text under a byte-level vocabulary of ranks (default: the 50k one).

    The end marker's string in a text is its special token, as the vocabulary's own
    tokenizer has it. A text that this encoder gives up on goes to that tokenizer.
    """
    import base64

    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        pairs = [line.split() for line in f]
    ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    special = {"<|endoftext|>": len(ranks)}
    encoding = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
    )

    def encode(text: str) -> list[int]:
        try:
            return encoding.encode(text, allowed_special="all")
        except BaseException as e:
            if type(e).__name__ != "PanicException":  # very long runs of white space
                raise
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            return slow.encode(text, add_special_tokens=False).ids

    return encode


class Windows:
    """Open windows and what is in them; ``emit`` takes a window's pieces."""

    def __init__(self, window: int, most: int, emit: Callable[[list], None]):
        self.window, self.most, self.emit = window, most, emit
        self.rooms: list[tuple[int, int]] = []  # room left and number, sorted
        self.pieces: dict[int, list] = {}
        self.made = 0

    def add(self, piece: tuple, length: int) -> None:
        """Best fit; else a new window, the fullest being emitted if all are open."""
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, k = self.rooms.pop(at)
        else:
            if len(self.rooms) == self.most:
                self.emit(self.pieces.pop(self.rooms.pop(0)[1]))
            room, k = self.window, self.made
            self.made += 1
            self.pieces[k] = []
        self.pieces[k].append((piece, self.window - room, length))
        if room == length:
            self.emit(self.pieces.pop(k))
        else:
            insort(self.rooms, (room - length, k))

    def rest(self) -> Iterator[list]:
        for _, k in self.rooms:
            yield self.pieces[k]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.bool_() if n == "closed" else pa.int64() for n in NAMES]
    columns = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, NAMES)


class Sequences:
    """Rows of emitted windows; sequence ids are distinct over rounds, partitions and windows."""

    def __init__(self, level: int, part: int):
        self.rows: list[tuple] = []
        self.next, self.part = (level << 56) + (part << 28), part

    def put(self, window: list, closed: bool = True) -> None:
        for piece, offset, _ in window:
            self.rows.append((*piece, self.next, offset, closed, self.part))
        self.next += 1

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return _batch(rows)


def _first_round(tokenizer_path: str | None, window: int, most: int):
    def pack(batches):
        part = TaskContext.get().partitionId()
        encode, out = load_tokenizer(tokenizer_path), Sequences(0, part)
        windows = Windows(window, most, out.put)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "")
            for lo in range(0, len(ids), BATCH):
                for doc, text in zip(
                    ids[lo : lo + BATCH], texts.slice(lo, BATCH).to_pylist(), strict=True
                ):
                    tokens = np.array([*encode(text), END], "<u4")
                    n = len(tokens)
                    for a in range(0, n, window):
                        cut = tokens[a : a + window]
                        piece = (doc, a, len(cut), zlib.crc32(cut.tobytes()), n)
                        if len(cut) == window:
                            out.put([(piece, 0, window)])
                        else:
                            windows.add(piece, len(cut))
            yield out.take()
        for left in windows.rest():
            out.put(left, closed=False)
        yield out.take()

    return pack


def _merge_round(level: int, window: int, most: int | None):
    """Packs the pieces of one group's open windows, largest first; None keeps nothing open."""

    def merge(key, table):
        out = Sequences(level, key[0].as_py())
        rows = table.select(NAMES[:5]).to_pylist()
        rows.sort(key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"], r["start"]))
        windows = Windows(window, most or len(rows), out.put)
        for r in rows:
            windows.add(tuple(r.values()), r["length"])
        for left in windows.rest():
            out.put(left, closed=most is None)
        return pa.Table.from_batches([out.take()])

    return merge


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS, fan: int = FAN, tokenizer_path: str | None = None,
) -> DataFrame:
    """One row per piece: what it is of its document, and its place in its sequence."""
    texts = docs.select(named([id_col])[0].cast("long"), named([text_col])[0])
    first = texts.mapInArrow(_first_round(tokenizer_path, window, open_windows), PIECE)
    done = stage(first, "packed")
    parts = (done.agg(F.max("part")).first()[0] or 0) + 1
    out = [done.where("closed")]
    level, rest = 1, done.where("NOT closed")
    while True:
        last = parts <= fan
        group = (F.col("part") / fan).cast("long")
        merged = rest.withColumn("part", group).groupBy("part").applyInArrow(
            _merge_round(level, window, None if last else open_windows), PIECE
        )
        done = stage(merged, f"packed-{level}")
        out.append(done.where("closed"))
        if last:
            break
        parts, level, rest = -(-parts // fan), level + 1, done.where("NOT closed")
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.drop("closed", "part")
