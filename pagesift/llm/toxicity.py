"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another by logistic models over indicators; each
model also sees the probabilities of the categories before it. While fitting, these come
from models that did not see the row (out-of-fold predictions); the models that are kept
are fitted on all rows. The last category is toxicity itself. Those before it are given as
lists of words, or learned: the strongest indicators of toxicity are parted by which of them
stand in the same texts, whatever language they are in, and a toxic row belongs to every kind
that it has an indicator of.

Indicators are the words of a text (A-Z as a-z), beginnings of words, and beginnings that
two or three different words of the text share. Those that go with a category beyond a
chi-square threshold are looked up by their whole 64-bit hash, so that other words of a
long text weigh nothing.

Defined results: a null or empty text has the probabilities of the intercepts; without a
positive and a negative labelled row a category's probability is the share of positives;
labels other than 0 and 1, or null, are not used; repeated rows are scored each. Other
columns pass through, but for the probabilities ``p_<category>``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pagesift.functions.columns import named
from pagesift.llm.texts import (
    LOWER_VALUES, lists, map_batches, mix, prefix_hashes, slices, span_hashes, words,
)
from pagesift.sources.staging import stage

#: Labelled rows that the chain is fitted on: the first by a hash of the id.
SAMPLE = 20000
#: Indicators kept, the strongest first, and the chi-square from which one counts.
INDICATORS, CHI_SQUARE = 20000, 30.0
FOLDS = 5
BEGINNINGS = (5, 6, 7, 8, 9)

#: Categories before toxicity where none are given, and the indicators they are made of.
KINDS, STRONG = 2, 64

_IS_WORD = np.zeros(256, bool)
_IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def indicators(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct hashes of the indicators of each document."""
    start, end, doc = words(data, offsets, _IS_WORD)
    prefix = prefix_hashes(LOWER_VALUES[data])
    whole = span_hashes(prefix, start, end)
    begin = []
    for k in BEGINNINGS:
        long = end - start > k
        h = np.zeros(len(start), np.uint64)
        h[long] = mix(span_hashes(prefix, start[long], start[long] + k) + np.uint64(k))
        begin.append(h)
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own, at = np.unique(whole[a:b], return_index=True)
        out = [own]
        for h in begin:
            h = h[a:b][at]
            h, count = np.unique(h[h > 0], return_counts=True)
            out += [h, mix(h[count > 1] + np.uint64(2)), mix(h[count > 2] + np.uint64(3))]
        yield np.concatenate(out)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Linear:
    """Weights of the indicators, of the probabilities before, and the intercept."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def probability(self, margin, earlier):
        return sigmoid(margin + earlier @ self.earlier + self.bias)


@dataclass
class Chain:
    """Models of the categories in order, over the sorted hashes ``vocabulary``."""

    categories: list[str]
    vocabulary: np.ndarray
    models: list[Linear]

    def places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return at[self.vocabulary[at] == hashes]

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found = [self.places(h) for h in indicators(data, offsets)]
        out = np.zeros((len(found), 0))
        for model in self.models:
            margin = np.array([model.weights[f].sum() for f in found])
            out = np.column_stack([out, model.probability(margin, out)])
        return out


def logistic(
    row: np.ndarray, place: np.ndarray, size: int, earlier: np.ndarray, y: np.ndarray,
    ridge: float = 1e-5, rounds: int = 400,
) -> Linear:
    """Logistic regression by accelerated gradient steps; (row, place) are the indicators set."""
    n, k = len(y), earlier.shape[1]
    if not n or y.min() == y.max():
        share = np.clip(y.mean() if n else 0.5, 1e-6, 1 - 1e-6)
        return Linear(np.zeros(size), np.zeros(k), float(np.log(share / (1 - share))))
    w, e, b = np.zeros(size), np.zeros(k), 0.0
    old = (w, e, b)
    per_row = np.bincount(row, minlength=n)
    rate = 4 * n / max(1.0, (per_row + k + 1).mean() * n) * 4
    for t in range(rounds):
        m = t / (t + 3)
        vw, ve, vb = w + m * (w - old[0]), e + m * (e - old[1]), b + m * (b - old[2])
        margin = np.bincount(row, vw[place], n) + earlier @ ve + vb
        error = sigmoid(margin) - y
        old = (w, e, b)
        w = vw - rate * (np.bincount(place, error[row], size) / n + ridge * vw)
        e = ve - rate * (earlier.T @ error / n + ridge * ve)
        b = vb - rate * error.mean()
    return Linear(w, e, float(b))


def fit_models(
    found: list[np.ndarray], size: int, targets: np.ndarray, fold: np.ndarray
) -> list[Linear]:
    """The chain's models; ``targets`` has a column per category, ``fold`` the rows' folds."""
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    place = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
    n = len(found)
    earlier, models = np.zeros((n, 0)), []
    for c in range(targets.shape[1]):
        y = targets[:, c].astype(float)
        models.append(logistic(row, place, size, earlier, y))
        if c + 1 == targets.shape[1]:
            break
        unseen = np.zeros(n)
        for k in range(FOLDS):
            out = fold == k
            new = np.cumsum(~out) - 1
            use = ~out[row]
            model = logistic(new[row[use]], place[use], size, earlier[~out], y[~out])
            margin = np.bincount(row, model.weights[place], n)
            unseen[out] = model.probability(margin, earlier)[out]
        earlier = np.column_stack([earlier, unseen])
    return models


def kinds_of(places: list[np.ndarray], y: np.ndarray, strong: np.ndarray, kinds: int) -> np.ndarray:
    """The kind of each of the ``strong`` indicators, strongest first.

    The strongest leads the first kind; each other kind is led by the most frequent one that
    is hardly seen with the leaders before, and the rest go where they are seen most.
    """
    if not len(strong):
        return np.zeros(0, np.int64)
    toxic = [p for p, label in zip(places, y, strict=True) if label == 1]
    has = np.array([np.isin(strong, p) for p in toxic], float).reshape(-1, len(strong))
    together = has.T @ has
    n = np.maximum(np.diag(together), 1)
    share = together / np.minimum.outer(n, n)
    leaders = [0]
    while len(leaders) < min(kinds, len(strong)):
        apart = n * (1 - share[:, leaders].max(1))
        leaders.append(int(np.argmax(apart)))
    return np.argmax(share[:, leaders], axis=1)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", categories: dict[str, tuple[str, ...]] | None = None,
    sample: int = SAMPLE, most: int = INDICATORS, chi_square: float = CHI_SQUARE,
    kinds: int = KINDS,
) -> Chain:
    """A chain fitted on the first ``sample`` labelled rows.

    Indicators are counted by Spark; at most ``most`` from ``chi_square`` on are kept. Ids of
    the sample are broadcast; of its rows only the kept indicators come to the driver.
    ``categories`` are words by name; without them ``kinds`` are learned.
    """
    given = [] if categories is None else [_hashes(w) for w in categories.values()]
    names = [f"kind_{k + 1}" for k in range(kinds)] if categories is None else [*categories]
    doc, label = named([id_col, label_col])
    chosen = labels.where(label.isin(0, 1) & doc.isNotNull()).select(
        doc.alias("_id"), label.cast("int").alias("y")
    ).orderBy(F.xxhash64("_id"), "_id", "y").limit(sample)
    text = named([text_col])[0]
    rows = docs.select(doc.alias("_id"), text.alias("_text")).join(F.broadcast(chosen), "_id")

    def sets(batches):
        for batch in batches:
            for lo, data, offsets in slices(batch.column(2)):
                got = [h.view(np.int64) for h in indicators(data, offsets)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(got)), batch.column(1).slice(lo, len(got)),
                     pa.array(got, pa.list_(pa.int64()))], ["id", "y", "hashes"],
                )

    table = stage(
        rows.select("_id", "y", "_text").mapInArrow(sets, "id long, y int, hashes array<long>"),
        "toxic-sample",
    )
    n, positive = table.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    tests = (
        table.select("y", F.explode("hashes").alias("hash")).groupBy("hash")
        .agg(F.count("*").cast("double").alias("n"), F.sum("y").cast("double").alias("t"))
        .where((F.col("t") > 2) & (F.col("n") < n))
    )
    expected = F.col("n") * positive / max(n, 1)
    chi = (F.col("t") - expected) ** 2 * F.lit(float(n)) / (
        expected * (1 - F.lit(positive / max(n, 1))) * (F.lit(float(n)) - F.col("n"))
    )
    kept = tests.where(chi >= chi_square).orderBy(chi.desc(), "hash").limit(most)
    ordered = kept.select("hash").toArrow()["hash"].to_numpy().view(np.uint64)
    vocabulary = np.sort(ordered)
    chain = Chain([*names, label_col], vocabulary, [])

    def found(batches):
        for batch in batches:
            rows = [h.view(np.uint64) for h in lists(pa.chunked_array([batch.column(2)]))]
            own = [[int(np.isin(w, h).any()) for w in given] for h in rows]
            places = [np.sort(chain.places(h)) for h in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(own, pa.list_(pa.int32())),
                 pa.array(places, pa.list_(pa.int64()))], ["y", "given", "places"],
            )

    got = table.mapInArrow(found, "y int, given array<int>, places array<long>").toArrow()
    places, y = lists(got["places"]), got["y"].to_numpy()
    if categories is None:
        strong = np.searchsorted(vocabulary, ordered[:STRONG])
        kind = kinds_of(places, y, strong, kinds)
        own = [[bool(np.isin(strong[kind == k], p).any()) for k in range(kinds)] for p in places]
    else:
        own = lists(got["given"])
    targets = [np.array([*(int(g) * label for g in has), label]) for has, label in zip(own, y, strict=True)]
    order = sorted(range(len(places)), key=lambda i: (tuple(targets[i]), places[i].tobytes()))
    fold = np.arange(len(order)) % FOLDS
    size = len(chain.categories)
    chain.models = fit_models(
        [places[i] for i in order], len(vocabulary),
        np.array([targets[i] for i in order]).reshape(-1, size), fold,
    )
    return chain


def _hashes(terms: tuple[str, ...]) -> np.ndarray:
    out = []
    for term in terms:
        data = np.frombuffer(term.encode(), np.uint8)
        prefix = prefix_hashes(LOWER_VALUES[data])
        out.append(span_hashes(prefix, np.array([0]), np.array([len(data)]))[0])
    return np.array(out, np.uint64)


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with ``p_<category>`` for each category of the chain, in its order."""
    new = [f"p_{c}" for c in chain.categories]
    keep = [c for c in docs.columns if c not in new]
    at = keep.index(text_col)
    schema = StructType(
        [docs.schema[c] for c in keep] + [StructField(c, DoubleType()) for c in new]
    )

    def scored(batches):
        for batch in batches:
            parts = [chain.probabilities(data, off) for _, data, off in slices(batch.column(at))]
            values = np.concatenate([*parts, np.zeros((0, len(new)))])
            columns = [pa.array(np.ascontiguousarray(v)) for v in values.T]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*keep, *new])

    return map_batches(docs.select(*named(keep)), scored, schema)
