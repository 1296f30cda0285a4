"""Exact similarity join of word shingle sets by a token-group matrix.

Two documents link when their sets' Jaccard similarity is ``num / den`` or more. Documents
of equal sets are one class from the start. Then classes that cannot link are ruled out,
exactly: all but ``1 - num / den`` of a set must occur in other classes. That is tested on
the tokens of a fixed range of hash values first (a lower bound of what is unique), then on
whole sets of the classes left. What is left is split by prefixes: with tokens ordered from
rare to frequent, sets that link share one among their first ``n - ceil(n * num / den) + 1``.

Classes connected by shared prefix tokens are one neighbourhood. In it, similar classes are
partitioned into groups; the token-group matrix holds the union of each group's tokens; the
product of a query with the matrix bounds its overlap with every member, and only groups
that can reach the similarity are opened and their members compared. Large neighbourhoods
are dealt into blocks of a bounded number of classes, and blocks whose sizes can match
meet in pairs, each in a task of its own; a task returns a spanning forest of its links and
their numbers, never the pairs.

Defined results: a null text, and a text without words, has an empty set and no links; a
text of fewer words than a shingle is one shingle; rows that repeat an id are one document
in links; a null id has a null component and no links. Only the named columns are read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.columns import named
from pagesift.llm.components import components
from pagesift.llm.texts import lists, mix, shingle_sets, slices
from pagesift.sources.staging import release, stage

BLOCK = 128
GROUP = 16
TASK_CLASSES = 256
COLUMNS = 4096  # of the matrix that are dense at a time

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def needed(n: Column, num: int, den: int) -> Column:
    """The least overlap of a set of ``n`` with one it links with."""
    return F.floor((n * num + (den - 1)) / den).cast("long")


def _sets(words: int, share: float | None):
    """Sets of documents: with ``share`` only the tokens up to that share of all hashes."""
    limit = None if share is None else np.uint64(min(2**64 - 1, int(share * 2**64)))

    def sets(batches):
        for batch in batches:
            for lo, data, offsets in slices(batch.column(1)):
                got = shingle_sets(data, offsets, IS_WORD, words)
                n = np.array([len(s) for s in got], np.int64)
                prints = [
                    np.array([mix(s ^ np.uint64(k)).sum(dtype=np.uint64) for s in got], np.uint64)
                    for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F)
                ]
                f1, f2 = (mix(p + n.astype(np.uint64)).view(np.int64) for p in prints)
                if limit is not None:
                    got = [s[: np.searchsorted(s, limit)] for s in got]
                rest = [batch.column(i).slice(lo, len(got)) for i in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(got)), pa.array(n), pa.array(f1), pa.array(f2),
                     pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64())), *rest],
                    ["id", "n", "f1", "f2", "tokens", *batch.schema.names[2:]],
                )

    return sets


SETS = "id long, n long, f1 long, f2 long, tokens array<long>"


def _not_unique(sets: DataFrame, key: str, num: int, den: int) -> DataFrame:
    """The keys whose tokens found nowhere else are few enough to let them link."""
    alone = (
        sets.select(key, F.explode("tokens").alias("token")).groupBy("token")
        .agg(F.min(key).alias("low"), F.max(key).alias("high")).where(F.col("low") == F.col("high"))
        .groupBy(F.col("low").alias("key")).agg(F.count("*").alias("alone"))
    )
    sizes = sets.groupBy(key).agg(F.max("n").alias("n"))
    few = F.coalesce(F.col("alone"), F.lit(0)) <= F.col("n") - needed(F.col("n"), num, den)
    joined = sizes.join(alone, F.col(key) == F.col("key"), "left")
    return joined.where(few).select(key, "n", F.coalesce("alone", F.lit(0)).alias("alone"))


def _neighbourhoods(sets: DataFrame, left: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, neighbourhood) of the classes that share prefix tokens with others."""
    tokens = sets.join(left.select("rep", "alone"), "rep").select(
        "rep", "n", "alone", F.explode("tokens").alias("token")
    )
    tokens = stage(tokens, "jaccard-tokens")
    shared = stage(
        tokens.groupBy("token").agg(
            F.count("*").alias("df"), F.min("rep").alias("low"), F.max("rep").alias("high")
        ).where(F.col("low") != F.col("high")).select("token", "df"),
        "jaccard-shared",
    )
    # Tokens of one class alone come first in the order and meet nothing.
    length = F.col("n") - needed(F.col("n"), num, den) + 1 - F.col("alone")
    ordered = tokens.join(shared, "token").groupBy("rep").agg(
        F.max("n").alias("n"), F.max("alone").alias("alone"),
        F.sort_array(F.collect_set(F.struct("df", "token"))).alias("order"),
    )
    prefix = stage(
        ordered.select(
            "rep", F.explode(F.slice("order", F.lit(1), F.greatest(length, F.lit(0)).cast("int")))
            .alias("t")
        ).select("rep", "t.token"),
        "jaccard-prefixes",
    )
    hubs = stage(prefix.groupBy("token").agg(F.min("rep").alias("hub")), "jaccard-hubs")
    pairs = prefix.join(hubs, "token").where("rep <> hub").select("rep", "hub").distinct()
    found = components(pairs, "rep", "hub")
    release(tokens, shared, prefix, hubs)
    hub = found.select(F.col("component").alias("rep"), "component").distinct()
    return found.select(F.col("node").alias("rep"), "component").unionByName(hub)


def _tasks(classes: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(rep, task, part, side): the tasks each class takes part in.

    Neighbourhoods of one block go whole to one of the tasks for such; the others are dealt
    by size, so that only blocks of sizes within the similarity meet.
    """
    size = classes.groupBy("component").agg(F.count("*").alias("size"))
    band = F.floor(F.log(F.col("n")) / F.lit(float(np.log(den / num)))).cast("int")
    joined = classes.join(stage(size, "jaccard-sizes"), "component")
    small = joined.where(F.col("size") <= block)
    n_small = size.where(F.col("size") <= block).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(1, -(-n_small // TASK_CLASSES))
    few = small.select(
        "rep", F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("task"),
        F.col("component").alias("part"), F.lit(0).alias("side"),
    )
    large = joined.where(F.col("size") > block).withColumn("band", band)
    bands = stage(
        large.groupBy("component", "band").agg(
            F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")
        ),
        "jaccard-bands",
    )
    blocks = bands.select(
        "component", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    one = blocks.select("component", F.col("band").alias("b1"), F.col("block").alias("k1"))
    two = blocks.select("component", F.col("band").alias("b2"), F.col("block").alias("k2"))
    fits = (F.col("b2") == F.col("b1") + 1) | (
        (F.col("b2") == F.col("b1")) & (F.col("k2") >= F.col("k1"))
    )
    pairs = stage(
        one.join(two, "component").where(fits).withColumn(
            "part", F.xxhash64("component", "b1", "k1", "b2", "k2")
        ),
        "jaccard-blocks",
    )
    same = (F.col("b1") == F.col("b2")) & (F.col("k1") == F.col("k2"))
    meets = pairs.select(
        "component", F.col("b1").alias("band"), F.col("k1").alias("block"), "part",
        F.when(same, 0).otherwise(1).alias("side"),
    ).unionByName(
        pairs.where(~same).select(
            "component", F.col("b2").alias("band"), F.col("k2").alias("block"), "part",
            F.lit(2).alias("side"),
        )
    )
    placed = large.join(bands, ["component", "band"]).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    )
    many = placed.join(meets, ["component", "band", "block"]).select(
        "rep", F.col("part").alias("task"), "part", "side"
    )
    return few.unionByName(many)


def group_links(
    sets: list[np.ndarray], sides: np.ndarray, num: int, den: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places whose sets link; of sides 1 and 2 only pairs across.

    The token-group matrix of the sets on side 2 (or all) is met by the sets on side 1.
    """
    n = np.array([len(s) for s in sets])
    members = np.flatnonzero(sides != 1)
    queries = np.flatnonzero(sides != 2)
    values, inverse, count = np.unique(
        np.concatenate(sets), return_inverse=True, return_counts=True
    )
    doc = np.repeat(np.arange(len(sets)), n)
    column = np.cumsum(count > 1) - 1
    use = count[inverse] > 1
    doc, place = doc[use], column[inverse[use]]
    width = int(column[-1]) + 1 if len(column) else 0
    # Similar sets stand together: by size class and least shared tokens.
    least = np.full(len(sets), width)
    np.minimum.at(least, doc, place)
    members = members[np.lexsort((n[members], least[members]))]
    starts = np.arange(0, len(members), GROUP)
    need = -(-n[queries] * num // den)

    def dense(lo, rows):
        at = np.full(len(sets), -1)
        at[rows] = np.arange(len(rows))
        inside = (place >= lo) & (place < lo + COLUMNS) & (at[doc] >= 0)
        m = np.zeros((len(rows), min(COLUMNS, width - lo)), np.float32)
        m[at[doc[inside]], place[inside] - lo] = 1
        return m

    bound = np.zeros((len(queries), len(starts)), np.float32)
    for lo in range(0, width, COLUMNS):
        union = np.maximum.reduceat(dense(lo, members), starts, axis=0)
        bound += dense(lo, queries) @ union.T
    opened = bound >= need[:, None]
    left, right = [], []
    for g in np.flatnonzero(opened.any(0)):
        own, asking = members[starts[g] : starts[g] + GROUP], queries[opened[:, g]]
        overlap = np.zeros((len(asking), len(own)), np.float32)
        for lo in range(0, width, COLUMNS):
            overlap += dense(lo, asking) @ dense(lo, own).T
        overlap = overlap.astype(np.int64)
        union = n[asking][:, None] + n[own][None, :] - overlap
        i, j = np.nonzero(den * overlap >= num * union)
        left.append(asking[i])
        right.append(own[j])
    a = np.concatenate([*left, np.zeros(0, np.int64)]).astype(np.int64)
    b = np.concatenate([*right, np.zeros(0, np.int64)]).astype(np.int64)
    keep = (a < b) if not sides.any() else np.ones(len(a), bool)
    return a[keep], b[keep]


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """The smallest id that links lead to, for each place."""
    root = list(range(len(ids)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            x, y = (x, y) if ids[x] <= ids[y] else (y, x)
            root[y] = x
    return [int(ids[top(x)]) for x in range(len(ids))]


def _link(num: int, den: int):
    def link(key, table):
        ids, part = table["rep"].to_numpy(), table["part"].to_numpy()
        side, copies = table["side"].to_numpy(), table["copies"].to_numpy()
        sets = lists(table["tokens"])
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        rows: list[tuple] = []
        for own in np.split(order, cuts):
            if len(own) < 2:
                continue
            a, b = group_links([sets[i] for i in own], side[own], num, den)
            if not len(a):
                continue
            links = np.bincount(a, copies[own][b], len(own)) + np.bincount(
                b, copies[own][a], len(own)
            )
            roots = _forest(ids[own], a, b)
            rows += [
                (int(ids[i]), roots[k], int(links[k])) for k, i in enumerate(own) if links[k]
            ]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        arrays = [pa.array(c, pa.int64()) for c in columns]
        return pa.table(arrays, ["rep", "root", "links"])

    return link


def link_components(
    docs: DataFrame, num: int, den: int, words: int, id_col: str = "doc_id",
    text_col: str = "text", block: int = BLOCK,
) -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every row of ``docs``.

    ``component_id`` is the smallest id reachable by links; ``n_links`` counts the other
    documents that a document links with, copies included.
    """
    theta = Fraction(num, den)
    doc, text = named([id_col, text_col])
    texts = docs.select(doc.cast("long").alias("id"), text.alias("text"))
    share = min(1.0, float(2 * (1 - theta)))
    sample = stage(texts.mapInArrow(_sets(words, share), SETS), "jaccard-sample")
    all_sets = stage(sample.drop("tokens"), "jaccard-rows")
    usable = sample.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = stage(
        usable.groupBy("f1", "f2").agg(
            F.min("id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")
        ),
        "jaccard-classes",
    )
    some = classes.join(_not_unique(usable, "f1", num, den).select("f1"), "f1", "left_semi")
    wanted = stage(some.select("rep", F.col("f1").alias("own"), "copies"), "jaccard-wanted")
    release(sample)
    whole = stage(
        # The classes left grow with the rows: one plan for every number of them.
        texts.join(wanted.hint("merge"), F.col("id") == F.col("rep")).select("id", "text", "own", "copies")
        .mapInArrow(_sets(words, None), SETS + ", own long, copies long")
        .where("f1 = own").select(F.col("id").alias("rep"), "n", "tokens", "copies"),
        "jaccard-sets",
    )
    release(wanted)
    left = stage(_not_unique(whole, "rep", num, den), "jaccard-left")
    near = stage(_neighbourhoods(whole, left, num, den), "jaccard-neighbourhoods")
    tasks = _tasks(near.join(left.select("rep", "n"), "rep"), num, den, block)
    linked = stage(
        tasks.join(whole.select("rep", "tokens", "copies"), "rep").groupBy("task")
        .applyInArrow(_link(num, den), "rep long, root long, links long"),
        "jaccard-links",
    )
    release(whole, near, left)
    found = components(linked, "rep", "root")
    number = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = (
        classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .join(number, "rep", "left").select(
            "f1", "f2", F.coalesce("component", "rep").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    of_class = stage(of_class, "jaccard-components")
    release(classes, linked)
    rows = all_sets.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("f1"))
                           .alias("f1"), "f2")
    return rows.join(of_class, ["f1", "f2"], "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
    )


def oracle(num: int, den: int, words: int, table: str = "documents") -> str:
    """DuckDB SQL for ``doc_id, n_shingles, component_id, n_links`` of a table with unique ids."""
    upper = "".join(chr(c) for c in range(65, 91))
    gram = " || ' ' || ".join(f"ws[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE cut AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x09-\\x0D\\x20]+'),
        lambda x: x <> '') AS ws FROM {table}),
sets AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
        WHEN len(ws) < {words} THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - {words} + 2), lambda i: {gram}))
        END AS grams FROM cut),
sizes AS (SELECT doc_id, len(grams) AS n FROM sets),
flat AS MATERIALIZED (SELECT doc_id, unnest(grams) AS gram FROM sets),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i
    FROM flat x JOIN flat y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE {den} * i >= {num} * (x.n + y.n - i)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
lowest AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
degrees AS (SELECT a, count(*) AS n_links FROM ways GROUP BY a)
SELECT s.doc_id, s.n AS n_shingles, least(s.doc_id, coalesce(low, s.doc_id)) AS component_id,
       coalesce(n_links, 0) AS n_links
FROM sizes s LEFT JOIN lowest l ON l.a = s.doc_id LEFT JOIN degrees d ON d.a = s.doc_id"""
