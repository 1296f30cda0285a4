"""Approximate nearest neighbours by a forest of hash prefixes.

A tree gives every vector a string of 64 bits, the sides of 64 random planes it lies on,
and keeps the strings as a sorted array. A query descends every tree to the longest prefix
it shares with any vector, then all trees ascend together, one bit at a time, and the
vectors under the prefixes are candidates. Two vectors at an angle a share a bit with the
probability p = 1 - a / pi, so after x bits a vector as near as the k-th found so far is
still missing with (1 - p ** x) ** trees; the ascent ends when that is at most ``MISS``.
Vectors that lie close together are found near the leaves; among directions without any
structure the ascent goes on until a large part of the vectors has been looked at.

Vectors are dealt into blocks of a bounded number of rows, every block has a forest of its
own, and every block of queries visits every block of vectors; what they find is merged.

Defined results: null vectors, and vectors that are empty, zero, or hold null or non-finite
components, take no part; vectors of another length are no candidates; a row is no
candidate of a query of the same id; equal scores go by the smaller id; with fewer
candidates than asked for, all are returned; without queries or candidates, no rows. A null
id takes no part. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift.functions.columns import named

TREES = 24
BITS = 64
MISS = 0.03
BLOCK_ROWS = 16384
QUERY_ROWS = 4096

FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


class Forest:
    """Sorted arrays of hash strings over unit vectors."""

    def __init__(self, unit: np.ndarray, trees: int = TREES, seed: int = 1):
        rng = np.random.default_rng([seed, unit.shape[1]])
        self.planes = rng.standard_normal((unit.shape[1], trees * BITS))
        self.unit, self.trees = unit, trees
        codes = self.strings(unit)
        self.order = [np.argsort(codes[:, t], kind="stable") for t in range(trees)]
        self.sorted = [codes[o, t] for t, o in enumerate(self.order)]

    def strings(self, unit: np.ndarray) -> np.ndarray:
        out = np.empty((len(unit), self.trees), np.uint64)
        for lo in range(0, len(unit), 2048):
            bits = (unit[lo : lo + 2048] @ self.planes > 0).reshape(-1, self.trees, BITS)
            out[lo : lo + 2048] = np.packbits(bits, axis=2).view(">u8")[..., 0]
        return out

    def ranges(self, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings lie that share ``depth`` bits: first and last, by code and tree."""
        tail = np.uint64((1 << (BITS - depth)) - 1) if depth else np.uint64(2**64 - 1)
        low, high = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        for t in range(self.trees):
            low[:, t] = np.searchsorted(self.sorted[t], codes[:, t] & ~tail, "left")
            high[:, t] = np.searchsorted(self.sorted[t], codes[:, t] | tail, "right")
        return low, high

    def search(
        self, queries: np.ndarray, own: list[np.ndarray], k: int, miss: float
    ) -> list[np.ndarray]:
        """Candidates of each query, those in ``own`` apart (rows of the query's own id)."""
        codes = self.strings(queries)
        seen = [np.zeros(len(self.unit), bool) for _ in queries]
        best = np.full((len(queries), k), -np.inf)
        for i, rows in enumerate(own):
            seen[i][rows] = True
        out: list[list[np.ndarray]] = [[] for _ in queries]
        active = np.arange(len(queries))
        for depth in range(BITS, -1, -1):
            if not len(active):
                break
            low, high = self.ranges(codes[active], depth)
            going = []
            for j, i in enumerate(active):
                new = np.zeros(len(self.unit), bool)
                for t in range(self.trees):
                    new[self.order[t][low[j, t] : high[j, t]]] = True
                rows = np.flatnonzero(new & ~seen[i])
                if len(rows):
                    seen[i][rows] = True
                    out[i].append(rows)
                    near = np.concatenate([best[i], self.unit[rows] @ queries[i]])
                    best[i] = -np.sort(-near)[:k]
                kth = best[i, -1]
                same = 0.0 if kth < -1 else 1 - np.arccos(min(kth, 1.0)) / np.pi
                if (1 - same**depth) ** self.trees > miss:
                    going.append(i)
            active = np.array(going, np.int64)
        return [np.concatenate([*o, np.zeros(0, np.int64)]).astype(np.int64) for o in out]


def _search_block(k: int, trees: int, miss: float):
    def search(key, table):
        ids = table["vec_id"].to_numpy()
        query = table["is_query"].to_numpy(zero_copy_only=False)
        vectors = table["vector"].combine_chunks()
        x = vectors.values.to_numpy().astype(np.float64).reshape(len(ids), -1)
        norm = np.sqrt((x * x).sum(1))
        found: list[tuple] = []
        if query.any() and not query.all():
            rows, own_ids = x[~query], ids[~query]
            forest = Forest(rows / norm[~query][:, None], trees)
            places = np.flatnonzero(query)
            for lo in range(0, len(places), 64):
                part = places[lo : lo + 64]
                own = [np.flatnonzero(own_ids == ids[p]) for p in part]
                got = forest.search(x[part] / norm[part][:, None], own, k, miss)
                for p, near in zip(part, got, strict=True):
                    score = rows[near] @ x[p] / (norm[~query][near] * norm[p])
                    top = np.lexsort((own_ids[near], -score))[:k]
                    found += [(ids[p], own_ids[near[t]], score[t]) for t in top]
        columns = zip(*found, strict=True) if found else ([], [], [])
        types = (pa.int64(), pa.int64(), pa.float64())
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.table(arrays, ["query_id", "vec_id", "score"])

    return search


def nearest(
    table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
    vector_col: str = "embedding", trees: int = TREES, miss: float = MISS,
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of the largest cosine found."""
    vec, vector = named([id_col, vector_col])
    rows = table.where(vec.isNotNull() & usable(vector)).select(
        vec.cast("long").alias("vec_id"), vector.alias("vector"),
        F.size(vector).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, parts = max(1, -(-n // block_rows)), max(1, -(-asked // query_rows))

    def dealt(df, column, across, n_own, n_across):
        own = F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(n_across - 1)))
        return df.select("vec_id", "vector", "dim", own.alias(column), every.alias(across))

    stored = dealt(rows, "block", "part", blocks, parts).withColumn("is_query", F.lit(False))
    queries = dealt(rows.where("asks"), "part", "block", parts, blocks).withColumn(
        "is_query", F.lit(True)
    )
    found = stored.unionByName(queries).groupBy("dim", "block", "part").applyInArrow(
        _search_block(k, trees, miss), FOUND
    )
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
