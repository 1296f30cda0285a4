import collections
import random
import re

import numpy as np
import pytest

from pagesift.llm import jaccard as J
from pagesift.llm.components import components

_LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, num, den, k):
    """Component and number of links by comparing all pairs that share a shingle."""
    sets = {}
    for d, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(_LOWER)) if x]
        grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else [])
        sets[d] = frozenset(grams)
    where = collections.defaultdict(list)
    root, links = {d: d for d in sets}, collections.Counter()

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for d in sorted(sets):
        shared = collections.Counter(e for g in sets[d] for e in where[g])
        for e, i in shared.items():
            if den * i >= num * (len(sets[d]) + len(sets[e]) - i):
                links[d] += 1
                links[e] += 1
                a, b = sorted((top(d), top(e)))
                root[b] = a
        for g in sets[d]:
            where[g].append(d)
    return {d: (len(sets[d]), top(d), links[d]) for d in sets}


def found(df, *args, **more):
    rows = J.link_components(df, *args, **more).collect()
    return {r.id: (r.n_shingles, r.component_id, r.n_links) for r in rows}


@pytest.mark.parametrize("args", [(90, 100, 3), (80, 100, 5)])
def test_documents(documents, args):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert found(documents, *args) == brute(rows, *args)


def test_one_large_neighbourhood_in_blocks(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base, rows = [rng.choice(words) for _ in range(80)], []
    for d in range(90):
        own = list(base)
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((d, " ".join(own[: rng.randrange(70, 81)])))
    rows += [(100 + d, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))))
             for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for args in ((90, 100, 3), (80, 100, 5), (3, 5, 2)):
        assert found(df, *args, block=8) == brute(rows, *args)


def test_group_links_against_all_pairs():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        base = sets[rng.integers(len(sets))] if sets and rng.random() < 0.7 else rng.integers(
            0, 10000, rng.integers(1, 60)).astype(np.uint64)
        sets.append(np.unique(np.append(base[rng.random(len(base)) < 0.97],
                                        rng.integers(0, 10000, 1).astype(np.uint64))))
    sides = np.zeros(60, np.int64)
    a, b = J.group_links(sets, sides, 9, 10)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60)
            if 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and want
    sides = np.arange(60) % 2 + 1
    a, b = J.group_links(sets, sides, 9, 10)
    across = {(i, j) for i, j in want if sides[i] != sides[j]}
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == across


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{x: 100 for x in range(101, 160)}}


def test_edges(edges, empty):
    rows = J.link_components(edges, 90, 100, 3).collect()
    assert len(rows) == edges.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.id].append((r.n_shingles, r.component_id, r.n_links))
    assert by[3] == [(0, 3, 0)] and by[4] == [(0, 4, 0)] and by[6] == [(0, 6, 0)]
    assert by[7] == [(1, 7, 0)] and {c for _, c, _ in by[None]} == {None}
    assert by[1].count((6, 1, 1)) == 2  # repeated rows link with each other
    assert J.link_components(empty, 90, 100, 3).count() == 0


def test_words_that_a_polynomial_hash_takes_for_equal(spark):
    """Two words of 1,024 letters that every odd base modulo a power of two maps to one value."""
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"{thue} {rest}"), (2, f"{other} {rest}"), (3, thue), (4, other), (5, thue.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component_id for r in J.link_components(df, 99, 100, 3).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_word_hashes_differ_where_words_do():
    import random

    import numpy as np

    from pagesift.llm.texts import word_hashes

    rng = random.Random(1)
    words = {bytes(rng.choice([0, 97, 98, 255]) for _ in range(rng.choice([1, 2, 7, 8, 9, 31, 32, 33, 40])))
             for _ in range(20000)}
    words = sorted(words) * 2
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    h = word_hashes(np.frombuffer(b"".join(words), np.uint8), start, end)
    n = len(words) // 2
    assert (h[:n] == h[n:]).all() and len(set(h[:n].tolist())) == n
