"""Repair of broken conversations at the least cost, each repair told by an audit string.

A row's fault is the first of: blank (no text but white space), duplicate (role and text stand
earlier in the conversation), truncated (the text does not end in a full stop, exclamation or
question mark). Edits make the initials of the roles match ``(s?(ua)+)?``: a row is kept (K, 0),
given the role user or assistant (R, 1) or deleted (D, 2; the only way with blank and
duplicate ones), and an empty row of either role is put in anywhere (I, 5). A truncated row that
stays costs 5 more. The audit is the letters in order, of equal costs the least in ASCII.

Suffix-shared automaton: a conversation is a signature, one letter a row for its role and
fault. Distinct signatures, read from the end, are range-partitioned and sorted, so that those
with a common suffix follow each other; a node of the automaton is a suffix, the path of the last
signature is a stack, and only nodes below the common suffix are new. A node gets its
cost-to-go and best first letter once for each of the four states of the grammar, from those of
the suffix without its first row; the rest of the best audit is the link to them. From one state
and node each letter leads to one state only, so the least letter of least cost gives the least audit.

Rows are ordered by conversation and turn across tasks, not gathered by conversation: a long
conversation lies in several tasks and meets again as signature, a byte a row. Texts are
fetched for the rows that stay, by row number.

Defined results: null role and text are one space; rows of a null conversation are one
conversation; null turns come first; rows of one turn are ordered by role and md5 of the text,
repeated rows are duplicates; a role's initial is its first character, with no role other than
s, u, a legal; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.columns import named
from pagesift.llm.texts import map_batches
from pagesift.sources.staging import stage

KEEP_COST, ROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
ROLES = "sua"  # then any other
FAULTS = ("none", "truncated", "blank", "duplicate")
NONE, TRUNCATED, BLANK, DUPLICATE = range(4)
#: A row's letter tells role and fault; in signatures rows that must go are all DEAD.
LETTERS = "abcdefghijklmnop"
DEAD = "x"
GONE = "".join(x for i, x in enumerate(LETTERS) if i % 4 >= BLANK)
PIECE_ROWS = 1 << 16

#: States: nothing yet, after s, after u, after a. What keeping a role or putting one in leads to.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FORCED = (2, 2, 3, 2)
ROLE_OF = {2: "user", 3: "assistant"}
FAR = 1 << 60

BLANKS = " \t\n\v\f\r"


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) broken in a way that their names alone decide.

    The remainder by 20 of the crc32 of ``conv:turn``: 0 drops the row, 1 empties the text,
    2 takes out full stops, exclamation and question marks, 3 repeats the row, 4 makes it the
    user's.
    """
    c, t, r, x = named([conv, turn, role, text])
    key = F.concat(F.coalesce(c.cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(t.cast("string"), F.lit(" ")))
    told = rows.select(c.alias("conv_id"), t.cast("long").alias("turn"),
                       F.coalesce(r, F.lit(" ")).alias("role"), F.coalesce(x, F.lit(" ")).alias("text"),
                       (F.crc32(key) % 20).alias("harm"))
    harm = F.col("harm")
    return told.where("harm <> 0").select(
        "conv_id", "turn", F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_"),
    ).drop("_")


def _letters(role: Column, fault: Column) -> Column:
    at = F.coalesce(F.nullif(F.instr(F.lit(ROLES), F.substring(role, 1, 1)), F.lit(0)), F.lit(4)) - 1
    at = F.when(role == "", 3).otherwise(at)
    return F.substring(F.lit(LETTERS), (at * 4 + fault + 1).cast("int"), F.lit(1))


def _told(rows: DataFrame) -> DataFrame:
    """Distinct rows with the letter of the first of them, how many there are and a number."""
    left = F.rtrim("text", F.lit(BLANKS))
    own = (
        F.when(left == "", BLANK).when(~F.right(left, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
        .otherwise(NONE)
    )
    told = rows.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("print"), own.alias("own"),
                       "row")
    once = stage(
        told.groupBy("conv_id", "turn", "role", "print").agg(
            F.min("own").alias("own"), F.min("row").alias("row"), F.count("*").alias("n")
        ),
        "conversation-rows",
    )
    # Turns have nulls first, as minimum of the order too.
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    again = once.where(f"own <> {BLANK}").groupBy(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("print").alias("p")
    ).agg(F.min(order).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (
        F.col("print") == F.col("p")
    )
    later = F.coalesce(F.col("first") < order, F.lit(False)) & (F.col("own") != BLANK)
    fault = F.when(later, DUPLICATE).otherwise(F.col("own"))
    return once.join(again, same, "left").select(
        "conv_id", "turn", "role", "print", "n", "row", _letters(F.col("role"), fault).alias("letter")
    )


PIECES = "part int, k int, letters string, rows array<long>, first_turn long, last_turn long, turns long"


def _pieces(most: int):
    """Letters and row numbers of consecutive rows of one conversation; repeats have number -1."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, kind = TaskContext.get().partitionId(), 0, None
        out: list[tuple] = []
        letters: list[str] = []
        numbers: list[int] = []
        conv, first, last, turns, have = None, None, None, 0, False

        def close():
            nonlocal made, turns, first, last
            if have and letters:
                out.append((conv, part, made, "".join(letters), list(numbers), first, last, turns))
                made += 1
            letters.clear()
            numbers.clear()
            first, last, turns = None, None, 0

        def take():
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            types = [kind, pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), *[pa.int64()] * 3]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["conv_id", "part", "k", "letters", "rows", "first_turn", "last_turn", "turns"],
            )

        for batch in batches:
            kind = batch.schema.types[0]
            for c, turn, letter, n, row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not have or c != conv:
                    close()
                    conv, have = c, True
                if turn is not None:
                    if turn != last:
                        turns += 1
                    last = turn
                    first = turn if first is None else first
                at = LETTERS.index(letter)
                rest = letter if at % 4 == BLANK else LETTERS[at - at % 4 + DUPLICATE]
                letters.append(letter)
                numbers.append(row)
                while n > 1:
                    more = min(n - 1, most)
                    letters.append(rest * more)
                    numbers.extend([-1] * more)
                    n -= more
                    if len(numbers) >= most and n > 1:
                        close()
                        first, last, turns = turn, turn, int(turn is not None)
                if len(numbers) >= most:
                    close()
            yield take()
        close()
        if kind is not None:
            yield take()

    return pieces


def _end() -> tuple[list[int], list[str]]:
    return _settle([0, FAR, FAR, 0], ["", "", "", ""])


def _settle(cost: list[int], first: list[str]) -> tuple[list[int], list[str]]:
    """Costs and letters once rows may be put in before what is left."""
    for _ in range(3):
        for s in range(4):
            if INSERT_COST + cost[FORCED[s]] < cost[s]:
                cost[s], first[s] = INSERT_COST + cost[FORCED[s]], "I"
    for s in range(4):
        if first[s] > "I" and INSERT_COST + cost[FORCED[s]] == cost[s]:
            first[s] = "I"
    return cost, first


def _node(letter: str, after: tuple[list[int], list[str]]) -> tuple[list[int], list[str]]:
    """Cost-to-go and best first letter, for each state, of a row before a known suffix."""
    rest = after[0]
    cost, first = [DELETE_COST + c for c in rest], ["D"] * 4
    if letter != DEAD:
        role, fault = divmod(LETTERS.index(letter), 4)
        own = TRUNCATED_COST if fault == TRUNCATED else 0
        initial = (ROLES + "?")[role]
        for s in range(4):
            to = KEPT[s].get(initial)
            if to is not None and own + KEEP_COST + rest[to] < cost[s]:
                cost[s], first[s] = own + KEEP_COST + rest[to], "K"
            if own + ROLE_COST + rest[FORCED[s]] < cost[s]:
                cost[s], first[s] = own + ROLE_COST + rest[FORCED[s]], "R"
    return _settle(cost, first)


def step(state: int, op: str, letter: str) -> int:
    """The state after an edit of a row of this letter."""
    if op == "D":
        return state
    return KEPT[state][(ROLES + "?")[LETTERS.index(letter) // 4]] if op == "K" else FORCED[state]


class Automaton:
    """The suffixes of the last signature, as nodes; signatures come sorted from their ends."""

    def __init__(self):
        self.nodes, self.path, self.made = [_end()], "", 0

    def solve(self, backwards: str) -> tuple[int, str]:
        """Least cost and least audit of the signature that ``backwards`` spells from its end."""
        same = next(
            (i for i, (a, b) in enumerate(zip(self.path, backwards, strict=False)) if a != b),
            min(len(self.path), len(backwards)),
        )
        del self.nodes[same + 1 :]
        for letter in backwards[same:]:
            self.nodes.append(_node(letter, self.nodes[-1]))
        self.made += len(backwards) - same
        self.path = backwards
        audit, state, left = [], 0, len(backwards)
        while op := self.nodes[left][1][state]:
            audit.append(op)
            if op == "I":
                state = FORCED[state]
            else:
                left -= 1
                state = step(state, op, backwards[left])
        return self.nodes[-1][0][0], "".join(audit)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        backwards = batch.column(0).to_pylist()
        found = [automaton.solve(b) for b in backwards]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b[::-1] for b in backwards], pa.string()), pa.array([c for c, _ in found], pa.int64()),
             pa.array([a for _, a in found], pa.string())],
            ["signature", "cost", "audit"],
        )


CUTS = "array<struct<part int, k int, ops string, state int, position long>>"


def cut_audit(audit: str, letters: list[str]) -> list[tuple[str, int, int]]:
    """(edits, state before, rows before) of each piece; what is put in at the end is the last's."""
    out, at, state, position = [], 0, 0, 0
    for piece in letters:
        ops, before, rows_before, done = [], state, position, 0
        while done < len(piece):
            op = audit[at]
            at += 1
            ops.append(op)
            position += op != "D"
            if op == "I":
                state = FORCED[state]
            else:
                state = step(state, op, piece[done])
                done += 1
        out.append(("".join(ops), before, rows_before))
    if out:
        out[-1] = (out[-1][0] + audit[at:], *out[-1][1:])
    return out


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    legal = np.zeros((4, 4), bool)
    for a, b in ("su", "ua", "au"):
        legal[ROLES.index(a), ROLES.index(b)] = True
    for batch in batches:
        convs, audits = batch.column(0), batch.column(1).to_pylist()
        rows, cuts = [], []
        for audit, parts in zip(audits, batch.column(2).to_pylist(), strict=True):
            codes = np.frombuffer("".join(p["letters"] for p in parts).encode(), np.uint8) - ord("a")
            faults = np.bincount(codes % 4, minlength=4)
            role = codes // 4
            ends = [p for p in parts if p["first_turn"] is not None]
            turns = sum(p["turns"] for p in parts) - sum(
                a["last_turn"] == b["first_turn"] for a, b in zip(ends[:-1], ends[1:], strict=True)
            )
            gaps = ends[-1]["last_turn"] - ends[0]["first_turn"] + 1 - turns if ends else 0
            rows.append((gaps, int(faults[BLANK]), int(faults[DUPLICATE]), int(faults[TRUNCATED]),
                         int((~legal[role[:-1], role[1:]]).sum())))
            cuts.append([
                {"part": p["part"], "k": p["k"], "ops": ops, "state": state, "position": position}
                for p, (ops, state, position) in zip(
                    parts, cut_audit(audit, [p["letters"] for p in parts]), strict=True
                )
            ])
        numbers = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kind = pa.list_(pa.struct([("part", pa.int32()), ("k", pa.int32()), ("ops", pa.string()),
                                   ("state", pa.int32()), ("position", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [convs, *(pa.array(c, pa.int64()) for c in numbers), batch.column(3), batch.column(1),
             pa.array(cuts, kind)],
            ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "cuts"],
        )


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, position, row, role): rows that stay, with a new role, and rows put in (no number)."""
    for batch in batches:
        convs, place, at, number, role = [], [], [], [], []
        for i, (letters, rows, ops, state, position) in enumerate(
            zip(*(batch.column(j).to_pylist() for j in range(1, 6)), strict=True)
        ):
            done = 0
            for op in ops:
                if op == "I":
                    state = FORCED[state]
                else:
                    state = step(state, op, letters[done])
                    done += 1
                if op != "D":
                    convs.append(i)
                    place.append(position)
                    number.append(None if op == "I" else rows[done - 1])
                    role.append(None if op == "K" else ROLE_OF[state])
                    position += 1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(convs, pa.int64())), pa.array(place, pa.int64()),
             pa.array(number, pa.int64()), pa.array(role, pa.string())],
            ["conv_id", "position", "row", "role"],
        )


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", piece_rows: int = PIECE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(one row per conversation, repaired rows).

    The first has conv_id, gaps (turns missing between the least and the greatest), blank,
    duplicate, truncated, illegal (neighbours whose roles may not follow each other), cost and
    audit; the second conv_id, position, role, text.
    """
    c, t, r, x = named([conv, turn, role, text])
    kind = dict(rows.select(c.alias("conv_id")).dtypes)["conv_id"]
    kept = stage(
        rows.select(c.alias("conv_id"), t.cast("long").alias("turn"), F.coalesce(r, F.lit(" ")).alias("role"),
                    F.coalesce(x, F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("row")),
        "conversations",
    )
    told = stage(_told(kept), "conversation-letters")
    order = ["conv_id", "turn", "role", "print"]
    pieces = stage(
        map_batches(
            told.repartitionByRange(*order).sortWithinPartitions(*order)
            .select("conv_id", "turn", "letter", "n", "row"), _pieces(piece_rows), f"conv_id {kind}, {PIECES}"
        ),
        "conversation-pieces",
    )
    whole = stage(
        pieces.groupBy("conv_id").agg(
            F.sort_array(F.collect_list(
                F.struct("part", "k", "letters", "first_turn", "last_turn", "turns")
            )).alias("parts")
        ).withColumn("signature", F.translate(F.array_join("parts.letters", ""), GONE, DEAD * len(GONE))),
        "conversation-signatures",
    )
    backwards = F.reverse("signature").alias("backwards")
    distinct = stage(whole.select(backwards).distinct(), "signatures")
    solved = map_batches(
        distinct.repartitionByRange("backwards").sortWithinPartitions("backwards"), _solve,
        "signature string, cost long, audit string",
    )
    counts = "gaps long, blank long, duplicate long, truncated long, illegal long"
    summary = stage(
        map_batches(
            whole.join(stage(solved, "signature-audits"), "signature")
            .select("conv_id", "audit", "parts", "cost"), _summaries,
            f"conv_id {kind}, {counts}, cost long, audit string, cuts {CUTS}",
        ),
        "conversation-audits",
    )
    cuts = summary.select(F.inline("cuts"))
    edits = stage(
        map_batches(
            pieces.join(cuts, ["part", "k"])
            .select("conv_id", "letters", "rows", "ops", "state", "position"),
            _edits, f"conv_id {kind}, position long, row long, role string",
        ),
        "conversation-edits",
    )
    stay = edits.where("row IS NOT NULL").withColumnRenamed("role", "new").drop("conv_id").join(kept, "row")
    repaired = stay.select("conv_id", "position", F.coalesce("new", "role").alias("role"), "text").unionByName(
        edits.where("row IS NULL").select("conv_id", "position", "role", F.lit("").alias("text"))
    )
    return summary.drop("cuts"), repaired


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, digest, kind = None, None, None
    for batch in batches:
        kind = batch.schema.types[0]
        done = []
        for c, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest is None or c != conv:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode())
        yield _hashes(done, kind)
    if digest is not None:
        yield _hashes([(conv, digest.hexdigest())], kind)


def _hashes(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([c for c, _ in rows], kind), pa.array([h for _, h in rows], pa.string())],
        ["conv_id", "repaired_sha256"],
    )


def text_hashes(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the lines ``role:text`` of each conversation, in order.

    The rows of a conversation pass through one hash one after the other; none are held.
    """
    kind = dict(repaired.dtypes)["conv_id"]
    lines = repaired.select("conv_id", "position", F.concat("role", F.lit(":"), "text").alias("line"))
    return map_batches(
        lines.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "line"),
        _hash_runs, f"conv_id {kind}, repaired_sha256 string",
    )
