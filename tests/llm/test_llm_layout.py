"""Nearest neighbours and packing."""

import collections
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagesift.llm import neighbours as N
from pagesift.llm import packing as P


def exact(vectors, ids, k=5):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    return {
        q: [ids[j] for j in np.lexsort((ids, -s[i])) if ids[j] != q][:k] for i, q in enumerate(ids)
    }


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    want = exact([r.embedding for r in rows], np.array([r.vec_id for r in rows]))
    got = collections.defaultdict(list)
    for r in N.nearest(table, F.col("vec_id") % 50 == 0, block_rows=500, query_rows=16).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {q for q in want if q % 50 == 0}
    hits = [v in want[q] for q, found in got.items() for _, v, _ in found]
    assert len(hits) == 5 * len(got) and np.mean(hits) >= 0.95
    for found in got.values():
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert [s for _, _, s in sorted(found)] == sorted((s for _, _, s in found), reverse=True)


def test_few_and_equal_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 1.0], 1),
            (4, [-1.0, 0.0], 1), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1),
            (8, [None, 1.0], 1), (9, [inf, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1),
            (None, [1.0, 0.0], 1), (0, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in N.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (0, 4, 4, -1.0)]
    assert N.nearest(df.where("false"), F.col("vec_id") == 0).count() == 0
    assert N.nearest(df, F.lit(None).cast("boolean")).count() == 0


def test_close_vectors_are_found_near_the_leaves():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32))
    x[:20] = x[0] + rng.normal(size=(20, 32)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    forest = N.Forest(x)
    found = forest.search(x[:1], [np.array([0])], 5, 0.03)[0]
    near = set(np.argsort(-(x @ x[0]))[1:6].tolist())
    assert near <= set(found.tolist()) and len(found) < 200


def check_packed(rows, texts, window=1024):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*slow.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    for d, own in ids.items():
        assert sum(n for _, n in pieces[d]) == len(own)
    for parts in [*pieces.values(), *sequences.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    used = [sum(n for _, n in s) for s in sequences.values()]
    assert max(used) <= window
    return sum(used) / (window * len(used))


def test_round_trip(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    one = P.pack(documents).collect()
    assert check_packed(one, texts) > 0.97
    many = documents.repartition(9, "doc_id")
    rounds = P.pack(many, open_windows=4, fan=2).collect()
    assert check_packed(rounds, texts) > 0.9
    assert len({r.sequence_id for r in rounds}) >= len({r.sequence_id for r in one})


def test_windows_keep_their_bound_and_fit_best():
    out = []
    w = P.Windows(10, 2, out.append)
    for k, n in enumerate([6, 7, 3, 4, 5, 9]):
        w.add(k, n)
        assert len(w.rooms) <= 2
    # 3 fits 7 best, 4 fills 6; 9 finds 5 open.
    assert [[p for p, _, _ in x] for x in out] == [[1, 2], [0, 3]]
    assert sorted(p for x in w.rest() for p, _, _ in x) == [4, 5]


def test_special_texts(spark, edges, empty):
    texts = ["a<|endoftext|>b", " " * 5000, "x" * 30000, "\u0000\n\r\t", "🙂" * 500, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_packed(P.pack(df).collect(), dict(enumerate(texts)))
    rows = P.pack(edges).collect()
    assert sum(r.start == 0 for r in rows) == edges.count()
    assert {r.length for r in rows if r.doc_id in (3, 4)} == {1}
    assert P.pack(empty).count() == 0
