"""Quality classifier: linear support vectors over n-grams scaled by naive Bayes ratios.

The n-grams are of a text's shape: letters, capitals and digits count as one symbol a run,
spaces, line feeds and every other ASCII character as themselves, so that the classifier
sees how a text is written in any language. An n-gram is an indicator; it is scaled by the
log ratio of its frequencies in the two classes, and a linear hinge-loss model is fitted to
the scaled indicators by dual coordinate descent.

Defined results: a null text is an empty one and has the score of the intercept; without
labelled rows of both classes every score is 0.5 (accepted); a label that is neither 0 nor
1, or null, is not used; a document with several labels counts with each; repeated rows are
scored each. Other columns pass through, but for ``score``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pagesift.functions.columns import named
from pagesift.llm.texts import lists, map_batches, mix, slices
from pagesift.sources.staging import stage

#: Labelled rows of each class that the model is fitted on: the first by a hash of the id.
SAMPLE_PER_CLASS = 4000
#: Distinct n-grams of both samples together that come to the driver, four bytes each.
SAMPLE_GRAMS = 1 << 25
FEATURES = 1 << 18
ORDERS = (1, 2, 3, 4, 5)

_CODES = np.full(256, 1, np.uint64)
_CODES[:128] = np.arange(10, 138)
_CODES[97:123] = 1
_CODES[65:91] = 2
_CODES[48:58] = 3


def shape_features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each document the hashed n-grams of its shape, with repeats."""
    codes = _CODES[data]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != codes[:-1]) | (codes[1:] > 3)
    keep[offsets[:-1][offsets[:-1] < len(codes)]] = True
    seq = codes[keep]
    bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
    grams, h = [], np.zeros(len(seq), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = max(0, len(seq) - n + 1)
        h = h[:m] * np.uint64(137) + seq[n - 1 : n - 1 + m]
        if n in ORDERS:
            hashed = mix(h + np.uint64(n << 56)) & np.uint64(FEATURES - 1)
            grams.append((n, hashed.astype(np.int64)))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.concatenate([g[a : max(a, b - n + 1)] for n, g in grams])


@dataclass
class Model:
    """``weights`` already hold the naive Bayes ratios; the bias is the score of no n-gram."""

    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        margin = np.full(len(offsets) - 1, self.bias)
        seen = np.full(FEATURES, -1, np.int64)
        for i, grams in enumerate(shape_features(data, offsets)):
            place = np.arange(len(grams))
            seen[grams] = place  # of repeats the last stays
            margin[i] += self.weights[grams[seen[grams] == place]].sum()
        return 1 / (1 + np.exp(-np.clip(2 * margin, -500, 500)))


def ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of an indicator's share in label 1 and in label 0."""
    counts = np.zeros((2, FEATURES))
    for y in (0, 1):
        own = [r for r, label in zip(rows, labels, strict=True) if label == y]
        counts[y] = np.bincount(np.concatenate(own), minlength=FEATURES)
    total = np.array([np.sum(labels == 0), np.sum(labels == 1)])[:, None]
    share = (counts + smooth) / (total + 2 * smooth)
    return np.where(counts.sum(0) > 0, np.log(share[1] / share[0]), 0.0)


def dual_coordinate_descent(
    rows: list[np.ndarray], scale: np.ndarray, labels: np.ndarray,
    c: float = 0.01, epochs: int = 15, seed: int = 7,
) -> Model:
    """Minimises |w|^2 / 2 + c * sum of hinge losses, one dual variable at a time."""
    w, bias = np.zeros(FEATURES), 0.0
    sign = np.where(labels == 1, 1.0, -1.0)
    values = [scale[r] for r in rows]
    norm = np.array([v @ v + 1 for v in values])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + bias) - 1
            step = min(max(alpha[i] - gradient / norm[i], 0.0), c) - alpha[i]
            if step:
                alpha[i] += step
                w[rows[i]] += step * sign[i] * values[i]
                bias += step * sign[i]
                most = max(most, abs(step))
        if most < 1e-4 * c:
            break
    return Model(w * scale, bias)


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the id as text modulo 3 is 1."""
    return F.coalesce(F.crc32(named([id_col])[0].cast("string")) % 3 == 1, F.lit(False))


def _last(sizes: pa.Table, label: int, most: int) -> int:
    """The order of the last row of a class that fits; rows of one id go together."""
    own = sizes.filter(pc.equal(sizes["label"], label))
    order, n = own["order"].to_numpy(), own["n"].to_numpy()
    at = np.argsort(order, kind="stable")
    fits = np.cumsum(n[at]) <= most
    taken = order[at[: max(1, int(fits.sum()))]]
    return int(taken[-1]) if len(taken) else -(2**63)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS, most_grams: int = SAMPLE_GRAMS,
) -> Model:
    """A model of the first ``per_class`` labelled rows of each class outside the held-out ones.

    Only ids of that number are broadcast and only their features come to the driver; where
    the texts are so long that there are more than ``most_grams``, those of the first rows
    by the same order, of each class half, and of each class one row at least.
    """
    doc, label = named([id_col, label_col])
    usable = labels.where(label.isin(0, 1) & doc.isNotNull() & ~held_out(id_col)).select(
        doc.alias("_id"), label.cast("int").alias("_label")
    )
    parts = [
        usable.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        for y in (0, 1)
    ]
    chosen = parts[0].unionByName(parts[1])
    order = F.xxhash64("_id").alias("_order")
    text = docs.select(doc.alias("_id"), *named([text_col])).join(
        F.broadcast(chosen), "_id"
    ).select("_label", named([text_col])[0].alias("text"), order)

    def features(batches):
        for batch in batches:
            for lo, data, offsets in slices(batch.column(1)):
                own = [np.unique(g).astype(np.int32) for g in shape_features(data, offsets)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(own)), pa.array(own, pa.list_(pa.int32())),
                     batch.column(2).slice(lo, len(own))],
                    ["label", "grams", "order"],
                )

    found = stage(text.mapInArrow(features, "label int, grams array<int>, order long"), "quality-grams")
    sizes = found.select("label", "order", F.size("grams").alias("n")).toArrow()
    last = [_last(sizes, label, most_grams // 2) for label in (0, 1)]
    some = F.when(F.col("label") == 1, last[1]).otherwise(last[0])
    got = found.where(F.col("order") <= some).toArrow()
    y = got["label"].to_numpy()
    if len(set(y)) < 2:
        return Model(np.zeros(FEATURES), 0.0)
    rows = lists(got["grams"])
    order = sorted(range(len(rows)), key=lambda i: (y[i], len(rows[i]), rows[i].tobytes()))
    rows, y = [rows[i] for i in order], y[order]
    return dual_coordinate_descent(rows, ratios(rows, y), y)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, from 0 to 1; the higher, the likelier is label 1."""
    keep = [c for c in docs.columns if c != "score"]
    at = keep.index(text_col)
    schema = StructType(
        [f for f in docs.schema.fields if f.name != "score"] + [StructField("score", DoubleType())]
    )

    def scored(batches):
        for batch in batches:
            parts = [model.scores(data, off) for _, data, off in slices(batch.column(at))]
            values = pa.array(np.concatenate([*parts, np.zeros(0)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*keep, "score"])

    return map_batches(docs.select(*named(keep)), scored, schema)
