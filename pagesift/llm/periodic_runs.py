"""Runs of repeated words, found in a grammar of the words.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are
identical), at least ``max(LEAST, POWER * q)`` long, that no neighbouring word extends.

Grammar-compressed detection, for as many whole documents as fit in ``SLICE_WORDS`` (or one
longer one): Re-Pair over the word ids replaces pairs of symbols that occur more than once by
nonterminals, in rounds; a round replaces every pair that is more frequent than those it overlaps.
What occurs once is paired too, neighbour by neighbour, so every document is one binary
derivation. A run has a lowest node that holds it, so it crosses the boundary between the two
halves of that node's nonterminal. Runs across its boundary are computed once per nonterminal, in
one of its expansions, translated to all positions where it is derived, and intervals of
one period that overlap by a period are merged into maximal ones.

At a boundary a run of four periods has two of them on one side, so for each period a block
of words equals the next one there. Names of all stretches of 2^j words (equal names, equal
words) tell that in one comparison, and how far the period reaches in a few more.

Defined results: a null text, and one without words, has no runs and an empty collapsed text;
ids may be null or repeated, every row gives one; an empty table gives no rows. Only the named
columns are read. Words are compared as they are, no hash stands in for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.columns import named
from pagesift.llm.texts import map_batches, mix

LEAST, POWER = 6, 4
SLICE_WORDS = 1 << 17
TESTS = 1 << 22  # periods tested at a time

RUNS = "array<struct<start bigint, length bigint, period bigint>>"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _replaced(keys: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs to replace in this round, and which pairs occur more than once.

    ``live`` tells which pairs may. In a run of one symbol every second place is taken.
    """
    at = np.flatnonzero(live)
    if not len(at):
        return at, live
    distinct, name, count = np.unique(keys[at], return_inverse=True, return_counts=True)
    often = count[name] > 1
    live = np.zeros(len(keys), bool)
    live[at[often]] = True
    if not often.any():
        return at[:0], live
    # Frequent first; equally frequent ones in an order without regard to their places.
    rank = np.empty(len(distinct), np.int64)
    rank[np.lexsort((mix(distinct.view(np.uint64)), count))] = np.arange(1, len(distinct) + 1)
    order = np.zeros(len(keys) + 2, np.int64)
    order[1:-1][at[often]] = rank[name[often]]
    own = order[1:-1]
    place = np.arange(len(keys))
    head = own != order[:-2]
    first = np.maximum.accumulate(np.where(head, place, 0))
    tail = own != order[2:]
    last = np.minimum.accumulate(np.where(tail, place, len(keys) - 1)[::-1])[::-1]
    best = (own > order[first]) & (own > order[last + 2])
    return np.flatnonzero(best & ((place - first) % 2 == 0)), live


def derive(words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(symbol, start, middle, end) of every node with two halves in the derivations.

    ``words`` are ids of 0 and more, ``docs`` the document of each, ascending. Nodes of one
    symbol have the same words.
    """
    symbol, start = words.astype(np.int64), np.arange(len(words))
    end = start + 1
    live = docs[1:] == docs[:-1]
    free = int(words.max()) + 1 if len(words) else 0
    nodes: list[tuple[np.ndarray, ...]] = []
    repeated = True
    while len(symbol) > 1:
        inside = docs[start[1:]] == docs[start[:-1]]
        if repeated:
            keys = symbol[:-1] << 32 | symbol[1:]
            at, live = _replaced(keys, live & inside)
            if not len(at):
                repeated = False
                continue
            _, name = np.unique(keys[at], return_inverse=True)
        else:
            # What is left occurs once: every second symbol of a document with the next.
            opens = np.r_[True, ~inside]
            place = np.arange(len(symbol))
            odd = (place - np.maximum.accumulate(np.where(opens, place, 0))) % 2
            at = np.flatnonzero(inside & (odd[:-1] == 0))
            if not len(at):
                break
            name = np.arange(len(at))
        nodes.append((free + name, start[at], start[at + 1], end[at + 1]))
        symbol[at] = free + name
        end[at] = end[at + 1]
        free += int(name.max()) + 1
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        new = np.zeros(len(symbol), bool)
        new[at] = True
        pairs = np.r_[live, False]
        symbol, start, end, new, pairs = symbol[keep], start[keep], end[keep], new[keep], pairs[keep]
        live = pairs[:-1] | new[:-1] | new[1:]
    if not nodes:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*nodes, strict=True))


def names(words: np.ndarray) -> np.ndarray:
    """Row j names the stretch of 2^j words from each place: equal names, equal words.

    What stands once has a negative name of its own; rows end when nothing stands twice.
    """
    n = len(words)
    own = -1 - np.arange(n)
    _, name, count = np.unique(words, return_inverse=True, return_counts=True)
    rows = [np.where(count[name] > 1, name, own)]
    while (rows[-1] >= 0).any():
        row, step = rows[-1], 1 << (len(rows) - 1)
        at = np.flatnonzero(row[: max(0, n - step)] >= 0)
        at = at[row[at + step] >= 0]
        out = own.copy()
        if len(at):
            _, name, count = np.unique(row[at] << 32 | row[at + step], return_inverse=True, return_counts=True)
            twice = count[name] > 1
            out[at[twice]] = name[twice]
        rows.append(out)
    return np.stack(rows)


def _reach(table: np.ndarray, at: np.ndarray, q: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """For how many words from ``at`` (before it, if ``step`` is -1) those ``q`` on are the same."""
    got = np.zeros(len(at), np.int64)
    n = table.shape[1]
    for j in range(len(table) - 1, -1, -1):
        size = 1 << j
        fits = got + size <= most
        x = at + got if step > 0 else at - got - size
        x = np.clip(x, 0, n - 1)
        got += size * (fits & (table[j, x] == table[j, np.minimum(x + q, n - 1)]))
    return got


def crossing(table: np.ndarray, s: np.ndarray, m: np.ndarray, e: np.ndarray):
    """(node, start, end, period) of the runs in [s, e) that hold the words on both sides of m."""
    most = (e - s) // POWER
    most[e - s < LEAST] = 0
    cuts = np.flatnonzero(np.diff(np.cumsum(most) // TESTS)) + 1
    found = []
    for nodes in np.split(np.arange(len(s)), cuts):
        nodes = nodes[most[nodes] > 0]
        if not len(nodes):
            continue
        node = np.repeat(nodes, most[nodes])
        q = np.arange(len(node)) - np.repeat(np.cumsum(most[nodes]) - most[nodes], most[nodes]) + 1
        # Four periods have two on one side: the block of a period there equals the next one.
        level = np.frexp(q.astype(float))[1] - 1
        can = level < len(table)
        node, q, level = node[can], q[can], level[can]
        right = m[node] + 2 * q <= e[node]
        left = m[node] - 2 * q >= s[node]
        x = np.where(right, m[node], 0)
        right &= table[level, x] == table[level, np.where(right, x + q, 0)]
        x = np.where(left, m[node] - 2 * q, 0)
        left &= table[level, x] == table[level, np.where(left, x + q, 0)]
        node, q, x = (
            np.r_[node[right], node[left]], np.r_[q[right], q[left]],
            np.r_[m[node[right]], m[node[left]] - q[left]],
        )
        after = _reach(table, x, q, e[node] - q - x, 1)
        before = _reach(table, x, q, x - s[node], -1)
        a, b = x - before, x + after + q
        good = (b - a >= np.maximum(LEAST, POWER * q)) & (a < m[node]) & (b > m[node])
        node, a, b, q = node[good], a[good], b[good], q[good]
        # A multiple of a period has the same interval: the least one counts.
        order = np.lexsort((q, b, a, node))
        node, a, b, q = node[order], a[order], b[order], q[order]
        new = np.ones(len(node), bool)
        new[1:] = (np.diff(node) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)
        found.append((node[new], a[new], b[new], q[new]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def find(words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs, by start and period."""
    symbol, start, middle, end = derive(words, docs)
    # Nodes by symbol: the first of each stands for its nonterminal.
    order = np.argsort(symbol, kind="stable")
    symbol, start, middle, end = symbol[order], start[order], middle[order], end[order]
    head = np.flatnonzero(np.r_[True, np.diff(symbol) != 0]) if len(symbol) else symbol
    count = np.diff(np.r_[head, len(symbol)])
    node, a, b, q = crossing(names(words), start[head], middle[head], end[head])
    times = count[node]
    shift = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    moved = start[np.repeat(head[node], times) + shift] - np.repeat(start[head[node]], times)
    a, b, q = np.repeat(a, times) + moved, np.repeat(b, times) + moved, np.repeat(q, times)
    # Periods one after the other on one line: overlaps of a period or more belong together.
    order = np.lexsort((a, q))
    a, b, q = a[order], b[order], q[order]
    line = (q - 1) * (len(words) + 1)
    reach = np.maximum.accumulate(b + line)
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(q) != 0) | (a[1:] + line[1:] > reach[:-1] - q[1:])
    at = np.flatnonzero(new)
    ends = reach[np.r_[at[1:], len(a)] - 1] - line[at] if len(at) else at
    a, b, q = a[at], ends, q[at]
    order = np.lexsort((q, a))
    return a[order], b[order], q[order]


def _slice(texts: list[list[bytes]]) -> tuple[list[list[tuple]], list[bytes]]:
    """Runs and collapsed text of each document, given as its words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode()
    words = flat.indices.to_numpy().astype(np.int64)
    a, b, q = find(words, np.repeat(np.arange(len(texts)), sizes))
    doc = np.searchsorted(starts, a, "right") - 1
    # An empty document has the start of the next one.
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, a + q, 1)
    np.add.at(gone, b, -1)
    gone = np.cumsum(gone)[:-1] > 0
    runs, left = [], []
    for i, own in enumerate(texts):
        lo, hi = bounds[i], bounds[i + 1]
        runs.append([
            {"start": int(x - starts[i]), "length": int(y - x), "period": int(p)}
            for x, y, p in zip(a[lo:hi], b[lo:hi], q[lo:hi], strict=True)
        ])
        if lo < hi:
            out = gone[starts[i] : starts[i] + sizes[i]].tolist()
            own = [w for w, skip in zip(own, out, strict=True) if not skip]
        left.append(b" ".join(own))
    return runs, left


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        lo, held, size = 0, [], 0

        def take(lo=0, held=()):
            runs, left = _slice(held)
            return pa.RecordBatch.from_arrays(
                [ids.slice(lo, len(held)), pa.array([len(t) for t in held], pa.int64()),  # noqa: B023
                 pa.array(runs, pa.list_(RUN)), pa.array(left, pa.binary()).cast(pa.string())],
                ["id", "n_words", "runs", "collapsed"],
            )

        for i, text in enumerate(texts):
            own = (text.as_py() or "").encode().split()  # at the six blanks of ASCII, as bytes
            if held and size + len(own) > SLICE_WORDS:
                yield take(lo, held)
                lo, held, size = i, [], 0
            held.append(own)
            size += len(own)
        if held:
            yield take(lo, held)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: its runs by start and period, and its words
    but for those that a run holds after its first period, joined by blanks."""
    doc, text = named([id_col, text_col])
    kind = dict(docs.select(doc.alias("id")).dtypes)["id"]
    return map_batches(
        docs.select(doc.alias("id"), text.alias("text")), _runs,
        f"id {kind}, n_words long, runs {RUNS}, collapsed string",
    )


def strongest(runs: Column) -> Column:
    """The run of the most periods; of equal ones the first, then that of the least period."""

    def order(a: Column, b: Column) -> Column:
        more, less = a["length"] * b["period"], b["length"] * a["period"]
        return (
            F.when(more > less, -1).when(more < less, 1).when(a["start"] < b["start"], -1)
            .when(a["start"] > b["start"], 1).when(a["period"] < b["period"], -1).otherwise(1)
        )

    return F.try_element_at(F.array_sort(runs, order), F.lit(1))


def plant_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) in which the texts that their ids choose go on periodically to their end.

    With ``h`` the crc32 of the id and ``g`` a tenth of it, texts of ``h % 10 = 0`` with n words
    repeat from word ``a = g % n`` the next ``1 + floor((n - a) / (3 + g % 8))`` words.
    """
    doc, text = named([id_col, text_col])
    h = F.crc32(doc.cast("string"))
    some = docs.select(doc.alias("doc_id"), text.alias("text"), h.alias("h"),
                       F.expr("cast(null as array<string>)").alias("w"))
    cut = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    some = some.withColumn("w", F.when(F.col("h") % 10 == 0, cut))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    some = some.withColumn("a", F.when(n > 0, g % n))
    p = F.floor(1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    some = some.withColumn("p", p.cast("int")).withColumn("a", F.col("a").cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")),
                                     F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    words = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), n - F.col("a")))
    return some.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(words, " "))
                       .otherwise(F.col("text")).alias("text"))
