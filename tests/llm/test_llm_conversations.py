"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from pagesift.llm import conversations as C
from pagesift.llm.queries import QUERIES

LEGAL = {"", "s"}
BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def faults_of(rows):
    out, seen = [], set()
    for _, role, text in rows:
        left = text.rstrip(BLANK)
        if not left:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("none" if left[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, audit) and the repaired rows by uniform-cost search over whole audits."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, made = heapq.heappop(heap)
        state = "" if not initials else initials[-1]
        if (at, state) in done:
            continue
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, made
        done.add((at, state))

        def go(more, op, to, role=None, text=None):
            row = () if role is None else ((role, text),)
            new = initials + (role[:1] if role is not None else "")  # noqa: B023
            if re.fullmatch("s?(ua)*u?", new):
                heapq.heappush(heap, (cost + more, audit + op, to, new, made + row))  # noqa: B023

        for role in ("user", "assistant"):
            go(5, "I", at, role, "")
        if at < len(rows):
            _, role, text = rows[at]
            go(2, "D", at + 1)
            if faults[at] in ("none", "truncated"):
                own = 5 if faults[at] == "truncated" else 0
                if role:
                    go(own, "K", at + 1, role, text)
                for new in ("user", "assistant"):
                    go(own + 1, "R", at + 1, new, text)


def brute(rows):
    """The contract's row for rows (turn, role, text) in order."""
    faults = faults_of(rows)
    cost, audit, made = cheapest(rows, faults)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1],
                                       hashlib.md5(r[2].encode()).digest()))


def damaged(conv, rows):
    out = []
    for turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return in_order(out)


def as_rows(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_query_against_search(spark):
    path = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{path}/conversations.parquet").collect():
        want.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    want = {c: brute(damaged(c, rows)) for c, rows in want.items()}
    assert as_rows(QUERIES["op11_suffix_automaton"](spark, path)) == want


def test_random_and_odd_rows(spark, tmp_path):
    rng = random.Random(11)
    rows = []
    for conv in [None, *range(150)]:
        for _ in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([None, *range(9)]),
                         rng.choice(["user", "assistant", "system", "tool", "", None, "User"]),
                         rng.choice(["", " \n", "Yes.", "No!", "Why? \n", "cut", "é", None, "a. b"])))
    rows += [(200, 3, "user", "Same.")] * 7 + [(201, None, "user", "Hi.")] + [(202, 0, "user", "x" * 100000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("own") for c in ("row", "n", "letter", "print", "part", "cost", "a.b")}
    )
    path = str(tmp_path)
    df.write.parquet(f"{path}/conversations.parquet")
    want = {}
    for conv, *row in rows:
        want.setdefault(conv, []).append(tuple(row))
    want = {c: brute(damaged(c, r)) for c, r in want.items()}
    got = as_rows(QUERIES["op11_suffix_automaton"](spark, path))
    assert got.keys() == want.keys()
    # Rows of one turn have no order of their own but ours, so all must agree.
    assert got == want


def test_pieces_of_a_long_conversation_meet(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "cut", f"Row {t}."]))
            for t in range(700)] + [(2, 5, "user", "Again.")] * 60
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    summary, repaired = C.repair(df, piece_rows=16)
    by_conv = {1: in_order([r[1:] for r in rows if r[0] == 1]), 2: [r[1:] for r in rows if r[0] == 2]}
    hashes = as_rows(C.text_hashes(repaired))
    for r in summary.collect():
        assert (*tuple(r)[1:], *hashes.get(r.conv_id, (hashlib.sha256(b"").hexdigest(),))) == brute(
            by_conv[r.conv_id]
        )


def test_cut_in_pieces():
    letters = "".join(random.Random(1).choice("abefijmn" + "c") for _ in range(300))
    signature = letters.translate(str.maketrans(C.GONE, C.DEAD * len(C.GONE)))
    _, audit = C.Automaton().solve(signature[::-1])
    parts = [letters[i : i + 7] for i in range(0, 300, 7)]
    cuts = C.cut_audit(audit, parts)
    assert "".join(ops for ops, _, _ in cuts) == audit
    assert [p for _, _, p in cuts] == [
        sum(op != "D" for ops, _, _ in cuts[:i] for op in ops) for i in range(len(cuts))
    ]


def test_nodes_are_made_once_per_suffix():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("aef" + C.DEAD) for _ in range(rng.randint(0, 6))) for _ in range(500)})
    automaton = C.Automaton()
    for w in words:
        automaton.solve(w)
    assert automaton.made == len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op11_suffix_automaton"](spark, str(tmp_path)).count() == 0


def test_all_rows_dropped(spark, tmp_path):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = as_rows(QUERIES["op11_suffix_automaton"](spark, str(tmp_path)))
    assert got == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
