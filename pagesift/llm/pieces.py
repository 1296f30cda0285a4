"""SentencePiece ids of texts and texts of ids, for models made of merges.

Such a model puts the two neighbouring pieces together that make the piece of the best score,
the first of equal ones, until none make one. The same pieces are found without merging:
matches of an Aho-Corasick automaton give the pieces that begin at each place, the longest is
taken first, and a piece may follow another only if merging the two strings again gives just
these two (remembered by pair). A sequence in which all neighbours may is the model's own. Where
no piece may follow, the place is marked in a field of bits as failed and the piece before is
replaced by its next shorter one.

Blanks are one character, a piece holds it at its beginning or is made of it, and some letters
never stand together in a piece. So texts are cut into words that no piece reaches across; they
are encoded one by one and remembered, up to ``REMEMBERED`` of them. Pieces of blanks alone, which
share one score, come last: they are merged by themselves. Characters without a piece are their
bytes.

Refused with ``ValueError``: models of another type, that change texts before they cut them,
with pieces of a user or out of use, or whose blanks are not as told above.

Defined results: a null text is empty and has no ids; null ids have the empty text; ids out of
range are an error; ids of rows and rows without an id are handled like any other; an empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions.columns import named
from pagesift.llm.texts import map_batches

BLANK = "▁"
REMEMBERED = 1 << 18  # words, and as many of those before
SHORT = 64
PAIRS = 1 << 19
BATCH = 1 << 20  # characters encoded at a time
LETTER, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
REPLACEMENT = "�".encode()


def merge(symbols: list[str], rank: dict[str, int]) -> list[str]:
    """Symbols after all merges, the best score first, of equal ones the first place."""
    parts, n = list(symbols), len(symbols)
    if n <= SHORT:
        none = len(rank)
        ranks = [rank.get(a + b, none) for a, b in zip(parts[:-1], parts[1:], strict=True)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], none)
        return parts
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            both = parts[i] + parts[after[i]]
            if both in rank:
                heapq.heappush(heap, (rank[both], i, both))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j >= n or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p]


def _words(pieces: set[str]) -> str:
    """A pattern of stretches that no piece reaches across.

    Letters that stand together in any piece are of one kind; a stretch holds one kind, a blank
    belongs to the next one.
    """
    kind: dict[str, str] = {}

    def top(c: str) -> str:
        while kind.setdefault(c, c) != c:
            kind[c] = kind[kind[c]]
            c = kind[c]
        return c

    for p in pieces:
        for a, b in zip(p.lstrip(BLANK)[:-1], p.lstrip(BLANK)[1:], strict=True):
            kind[top(a)] = top(b)
    kinds: dict[str, list[str]] = {}
    for c in kind:
        kinds.setdefault(top(c), []).append(c)
    several = sorted((sorted(k) for k in kinds.values()), key=len, reverse=True)
    classes = ["[" + "".join(map(re.escape, k)) + "]+" for k in several]
    return f"{BLANK}*(?:{'|'.join([*classes, f'[^{BLANK}]'])})|{BLANK}+"


class Pieces:
    """A model, with what it remembers of words and pairs."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, [p.type for p in model.pieces]
        if model.trainer_spec.model_type != 2 or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("not a model of merges with blanks before words")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("the model changes texts")
        if not set(kinds) <= {LETTER, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model has pieces of a user or out of use")
        self.prefix = spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == LETTER}
        scores = sorted({p.score for p in model.pieces if p.type == LETTER}, reverse=True)
        place = {s: i for i, s in enumerate(scores)}
        self.rank = {p: place[model.pieces[i].score] for p, i in self.ids.items()}
        blanks = {p for p in self.ids if not p.strip(BLANK)}
        if any(BLANK in p[1:] for p in self.ids if p not in blanks) or any(
            self.rank[b] <= self.rank[p] for b in blanks if len(b) > 1
            for p in self.ids if p not in blanks and p[0] == BLANK and len(p) > 1
        ):
            raise ValueError("blanks inside of pieces, or merged before words are")
        ranks = [r for p, r in self.rank.items() if p not in blanks and len(p) > 1]
        letters = {c for p in self.ids for c in p}
        if len(ranks) != len(set(ranks)) or not letters <= set(self.ids):
            raise ValueError("pieces of one score, or letters without a piece")
        self.bytes = [0] * 256
        self.unknown = model.trainer_spec.unk_id
        self.fallback = BYTE in kinds
        self.surface: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
            self.surface.append(
                {CONTROL: b"", UNKNOWN: model.trainer_spec.unk_surface.encode(),
                 BYTE: bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else b""}
                .get(p.type, p.piece.replace(BLANK, " ").encode())
            )
        self.kind = np.array(kinds)
        self.usable: dict[str, tuple[int, str, int]] = {}
        self.shorter: dict[str, tuple[int, str, int] | None] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for p, i in self.ids.items():
            # Pieces that merges never give are none.
            if p not in blanks and (len(p) == 1 or merge(list(p), self.rank) == [p]) or p == BLANK:
                self.usable[p] = len(p), p, i
                self.automaton.add_word(p, self.usable[p])
        self.automaton.make_automaton()
        self.cut = re.compile(_words({p for p in self.ids if p not in blanks}))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # those known before as many others came
        self.pairs: dict[tuple[str, str], bool] = {}
        self.lone: dict[int, list[int]] = {}

    def may_follow(self, one: str, two: str) -> bool:
        """Whether merging the two strings again gives these two pieces."""
        ok = self.pairs.get((one, two))
        if ok is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[one, two] = merge(list(one + two), self.rank) == [one, two]
        return ok

    def _shorter(self, piece: str) -> tuple[int, str, int] | None:
        """The longest piece that the piece begins with."""
        if piece not in self.shorter:
            starts = (piece[:n] for n in range(len(piece) - 1, 0, -1))
            self.shorter[piece] = next((self.usable[p] for p in starts if p in self.usable), None)
        return self.shorter[piece]

    def _known_letters(self, longest: list[tuple], lo: int, hi: int) -> list[int]:
        """Ids of a stretch of letters that have pieces; ``longest`` has the longest at each place."""
        failed = None
        taken: list[tuple[int, str, int]] = []
        at, here = lo, longest[lo] if lo < hi else None
        while at < hi:
            while here is not None:
                bit = at + here[0] - lo
                if (failed is None or not failed[bit >> 3] >> (bit & 7) & 1) and (
                    not taken or self.may_follow(taken[-1][1], here[1])
                ):
                    break
                here = self._shorter(here[1])
            if here is not None:
                taken.append(here)
                at += here[0]
                here = longest[at] if at < hi else None
            else:
                if failed is None:
                    failed = bytearray((hi - lo >> 3) + 1)
                failed[at - lo >> 3] |= 1 << (at - lo & 7)
                last = taken.pop()
                at -= last[0]
                here = self._shorter(last[1])
        return [piece[2] for piece in taken]

    def _word(self, word: str) -> list[int]:
        """Ids of at most one blank and what stands before the next one."""
        longest: list[tuple | None] = [None] * len(word)
        for end, piece in self.automaton.iter(word):
            longest[end - piece[0] + 1] = piece  # shorter ones end earlier
        if None not in longest:
            return self._known_letters(longest, 0, len(word))
        out: list[int] = []
        lo = 0
        for i, here in enumerate(longest):
            if here is None:
                out += self._known_letters(longest, lo, i)
                out += [self.bytes[b] for b in word[i].encode()] if self.fallback else [self.unknown]
                lo = i + 1
        return out + self._known_letters(longest, lo, len(word))

    def _blanks(self, n: int) -> list[int]:
        """Ids of blanks that no word takes."""
        got = self.lone.get(n)
        if got is None:
            got = [self.ids[p] for p in merge([BLANK] * n, self.rank)]
            if n <= 4096:
                self.lone[n] = got
        return got

    def _segment(self, segment: str) -> bytes:
        """Ids of blanks and the word behind them, which is remembered unless it is long."""
        out = self.older.get(segment)
        if out is None:
            ids = self._new(segment)
            out = struct.pack(f"<{len(ids)}i", *ids)
        if len(self.known) >= REMEMBERED:
            self.known, self.older = {}, self.known
        if len(segment) <= SHORT:
            self.known[segment] = out
        return out

    def _new(self, segment: str) -> list[int]:
        word = segment.lstrip(BLANK)
        blanks = len(segment) - len(word)
        if not word:
            return self._blanks(blanks)
        if not blanks:
            return self._word(word)
        own = self._word(BLANK + word)
        alone = own[0] == self.ids.get(BLANK)
        return self._blanks(blanks - 1 + alone) + own[alone:]

    def encode(self, text: str) -> bytes:
        """Ids of a text, four bytes each."""
        if not text:
            return b""
        text = text.replace(" ", BLANK)
        out = []
        for segment in self.cut.findall(BLANK + text if self.prefix else text):
            got = self.known.get(segment)
            out.append(self._segment(segment) if got is None else got)
        return b"".join(out)

    @functools.cached_property
    def _surfaces(self) -> pa.Array:
        return pa.array(self.surface, pa.large_binary())

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Texts of the lists of ids between offsets."""
        spelled = self._surfaces.take(pa.array(ids))
        _, ends, data = spelled.buffers()
        at = np.frombuffer(ends, np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        raw = memoryview(data) if data is not None else memoryview(b"")
        kind = self.kind[ids]
        split = kind == CONTROL
        mixed = bool(split.any() and (kind == BYTE).any())
        out = []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            # Bytes on both sides of an id without a text do not belong together.
            apart = bool(split[lo:hi].any()) if mixed else False
            # The blank put in front goes with the first id that has a text or is none's.
            first = lo + int(np.argmax(kind[lo:hi] != CONTROL)) if hi > lo else lo
            skip = self.prefix and hi > first and kind[first] == LETTER and raw[at[first] : at[first] + 1] == b" "
            text = bytes(raw[at[first] + skip : at[hi]]) if hi > lo else b""
            try:
                whole = not apart and text.decode() is not None
            except UnicodeDecodeError:
                whole = False
            if not whole:
                text = self._with_replacements(ids[first:hi], bool(skip))
            out.append(text)
        return out

    def _with_replacements(self, ids: np.ndarray, skip: bool) -> bytes:
        """A text in which bytes that make no character are each replaced by one."""
        out, held = [], bytearray()

        def flush():
            at = 0
            while at < len(held):
                size = next((k for k in range(1, 5) if _is_character(bytes(held[at : at + k]))), 0)
                out.append(bytes(held[at : at + size]) if size else REPLACEMENT)
                at += size or 1
            held.clear()

        for i in ids.tolist():
            if self.kind[i] == BYTE:
                held += self.surface[i]
            else:
                flush()
                out.append(self.surface[i])
        flush()
        return b"".join(out)[skip:]


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


@functools.lru_cache(maxsize=2)
def load(path: str | None = None) -> Pieces:
    """The model at a path, by default the 32k one of the public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Pieces(path)


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if len(sizes) > lo:
        yield lo, len(sizes)


def _encode(path: str | None):
    def encode(batches):
        model = load(path)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
            for lo, hi in _slices(sizes, BATCH):
                coded = [model.encode(t or "") for t in texts.slice(lo, hi - lo).to_pylist()]
                offsets = np.zeros(len(coded) + 1, np.int32)
                np.cumsum([len(c) >> 2 for c in coded], out=offsets[1:])
                ids = pa.array(np.frombuffer(b"".join(coded), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), ids)],
                    ["id", "ids"],
                )

    return encode


def _decode(path: str | None):
    def decode(batches):
        model = load(path)
        for batch in batches:
            lists = batch.column(0)
            counts = lists.value_lengths().fill_null(0).to_pylist()
            for lo, hi in _slices([4 * n for n in counts], BATCH):
                part = lists.slice(lo, hi - lo)
                ids = part.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(model.surface)):
                    raise ValueError("an id that the model does not have")
                offsets = np.zeros(hi - lo + 1, np.int64)
                np.cumsum(counts[lo:hi], out=offsets[1:])
                texts = pa.array(model.decode(ids, offsets), pa.binary()).cast(pa.string())
                rest = [c.slice(lo, hi - lo) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*rest, texts], [*batch.schema.names, "decoded"])

    return decode


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None
) -> DataFrame:
    """(id, ids) of every row: the model's ids of its text, without ones for begin and end."""
    doc, text = named([id_col, text_col])
    kind = dict(docs.select(doc.alias("id")).dtypes)["id"]
    return map_batches(
        docs.select(doc.alias("id"), text.alias("text")), _encode(model_path), f"id {kind}, ids array<int>"
    )


def decode(coded: DataFrame, ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """(the list of ids, decoded, every other column): the texts that the ids spell."""
    ids = named([ids_col])[0].cast("array<int>")
    rest = [c for c in coded.columns if c not in (ids_col, "decoded")]
    taken = coded.select(ids.alias(ids_col), *named(rest))
    kinds = [f.dataType.simpleString() for f in taken.schema]
    schema = ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)) + ", decoded string"
    return map_batches(taken, _decode(model_path), schema).toDF(ids_col, *rest, "decoded")
