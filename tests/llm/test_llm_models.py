"""Quality and toxicity classifiers."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from pagesift.llm import quality as Q
from pagesift.llm import toxicity as T
from pagesift.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    rows = QUERIES["op4_nb_support_vectors"](spark, MEDIUM).join(
        spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id"
    ).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95
    good = [r for r in out if r.quality == 1]
    assert np.mean([r.predicted for r in good]) > 0.98


def test_held_out_labels_are_not_used(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    turned = labels.withColumn(
        "quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int")
    )
    one, two = Q.fit(docs, labels), Q.fit(docs, turned)
    assert one.bias == two.bias and np.array_equal(one.weights, two.weights)


def test_dual_coordinate_descent_finds_the_minimum():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(40)]
    y = (np.array([3 in r or 5 in r for r in rows])).astype(int)
    scale = rng.normal(size=Q.FEATURES)
    c = 0.1
    model = Q.dual_coordinate_descent(rows, scale, y, c, epochs=4000)
    w = np.where(scale != 0, model.weights / scale, 0)

    def loss(w, b):
        margins = np.array([w[r] @ scale[r] + b for r in rows]) * np.where(y == 1, 1, -1)
        return (w @ w + b * b) / 2 + c * np.maximum(0, 1 - margins).sum()

    best = loss(w, model.bias)
    for _ in range(300):
        step = np.zeros(Q.FEATURES)
        step[:12] = rng.normal(size=12) * 0.01
        assert loss(w + step, model.bias + rng.normal() * 0.01) >= best - 1e-6


def test_quality_edges(spark, edges, empty):
    labels = spark.createDataFrame(
        [(1, 1), (7, 0), (5, 1), (3, None), (None, 1), (8, 2)], "doc_id long, quality int")
    model = Q.fit(edges, labels)
    rows = Q.score(edges, model).collect()
    assert len(rows) == edges.count() and rows[0]["a.b"] == "own a.b"
    blank = {r.score for r in rows if not r.text}
    assert len(blank) == 1 and all(0 <= r.score <= 1 for r in rows)
    assert Q.score(empty, model).count() == 0
    none = Q.fit(edges, labels.where("quality = 1"))
    assert {r.score for r in Q.score(edges, none).collect()} == {0.5}


def test_toxicity_on_rows_that_were_not_fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = T.fit(docs, labels.where("doc_id % 2 = 0"))
    assert chain.categories == ["kind_1", "kind_2", "toxic"] and len(chain.models) == 3
    rows = T.score(docs, chain).join(labels.where("doc_id % 2 = 1 AND quality = 1"), "doc_id").collect()
    toxic = [r.p_toxic >= 0.5 for r in rows if r.toxic == 1]
    clean = [r.p_toxic >= 0.5 for r in rows if r.toxic == 0]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.005


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(1)
    found = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(400)]
    first = np.array([0 in f for f in found])
    second = first & np.array([1 in f for f in found])
    models = T.fit_models(found, 6, np.column_stack([first, second]), np.arange(400) % T.FOLDS)
    assert len(models[0].earlier) == 0 and models[1].earlier[0] > 0.5
    flat = T.fit_models(found, 6, np.zeros((400, 2)), np.arange(400) % T.FOLDS)
    assert all(m.weights.any() == False for m in flat)  # noqa: E712  one class only


def test_toxicity_edges(spark, edges, empty):
    labels = spark.createDataFrame(
        [(1, 1), (7, 0), (5, 0), (3, None), (None, 1), (8, 2)], "doc_id long, toxic int")
    chain = T.fit(edges, labels)
    rows = T.score(edges, chain).collect()
    assert len(rows) == edges.count() and rows[0]["a.b"] == "own a.b"
    assert len({r.p_toxic for r in rows if not r.text}) == 1
    assert T.score(empty, chain).count() == 0
    none = T.fit(edges, labels.where("false"))
    assert {r.p_toxic for r in T.score(edges, none).collect()} == {0.5}


def shape(text):
    """Symbols of a text: a run of letters, capitals or digits is one, other bytes are themselves."""
    out = []
    for b in (text or "").encode():
        kind = 1 if b >= 128 or 97 <= b < 123 else 2 if 65 <= b < 91 else 3 if 48 <= b < 58 else b + 10
        if not out or out[-1] != kind or kind > 3:
            out.append(kind)
    return out


def test_scores_are_those_of_the_features_spelled_out(spark, documents):
    """Indicators as n-grams of symbols, ratios and margins by their definitions."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = Q.fit(documents, labels)
    assert np.count_nonzero(model.weights) > 100

    def grams(text):
        s, mask = shape(text), 2**64 - 1
        found = set()
        for n in Q.ORDERS:
            for i in range(len(s) - n + 1):
                h = 0
                for x in s[i : i + n]:
                    h = (h * 137 + x) & mask
                h = (h + (n << 56)) & mask
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                    h = ((h ^ (h >> shift)) * factor) & mask
                found.add(h & (Q.FEATURES - 1))
        return found

    rows = Q.score(documents, model).collect()
    for r in rows[:60]:
        margin = model.bias + sum(model.weights[g] for g in sorted(grams(r.text)))
        assert abs(r.score - 1 / (1 + np.exp(-2 * margin))) < 1e-9
    own = [np.array(sorted(grams(t))) for t in ("Ab 1", "ab", "A-b")]
    got = Q.ratios(own, np.array([1, 0, 1]))
    for g in set(np.concatenate(own).tolist()):
        share = [(sum(g in o for o, y in zip(own, (1, 0, 1), strict=True) if y == k) + 1) / (n + 2)
                 for k, n in ((0, 1), (1, 2))]
        assert abs(got[g] - np.log(share[1] / share[0])) < 1e-12


def test_what_comes_to_the_driver_is_bounded(spark, documents, monkeypatch):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    taken = []
    whole = Q.dual_coordinate_descent

    def counted(rows, *rest):
        taken.append((len(rows), sum(map(len, rows))))
        return whole(rows, *rest)

    monkeypatch.setattr(Q, "dual_coordinate_descent", counted)
    for most in (Q.SAMPLE_GRAMS, 4000, 2):
        Q.fit(documents, labels, most_grams=most)
    (n, all_grams), (some, grams), (least, _) = taken
    assert 2 < some < n and grams <= 4000 < all_grams and least == 2


def test_kinds_are_learned_in_any_language(spark):
    """Two vocabularies that never meet, in an invented language, are two kinds."""
    rng = np.random.default_rng(4)
    bad = (["zorgul", "wexmat", "krilpo"], ["žluvna", "břindo", "дуремо"])
    plain = [f"{a}{b}" for a in ("ba", "ko", "mi", "lu") for b in ("nd", "rt", "sk", "lm")]
    rows, kind = [], {}
    for i in range(600):
        text = list(rng.choice(plain, 12))
        kind[i] = int(rng.integers(0, 4)) if i % 2 else None
        if kind[i] in (0, 1):
            text[3:5] = rng.choice(bad[kind[i]], 2)
        rows.append((i, " ".join(text), int(kind[i] in (0, 1))))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = T.fit(df.drop("toxic"), df.drop("text").where("doc_id < 400"))
    got = {r.doc_id: r for r in T.score(df.drop("toxic"), chain).where("doc_id >= 400").collect()}
    first = [r["p_kind_1"] >= 0.5 for d, r in got.items() if kind[d] == 0]
    swap = np.mean(first) < 0.5
    for d, r in got.items():
        one, two = (r["p_kind_2"], r["p_kind_1"]) if swap else (r["p_kind_1"], r["p_kind_2"])
        assert (one >= 0.5, two >= 0.5, r.p_toxic >= 0.5) == (kind[d] == 0, kind[d] == 1, kind[d] in (0, 1))


def test_chain_scores_are_those_of_its_weights(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    chain = T.fit(documents, labels, chi_square=3.0, most=500)
    assert 0 < len(chain.vocabulary) <= 500
    place = {int(h): i for i, h in enumerate(chain.vocabulary)}
    for r in T.score(documents, chain).collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        (own,) = T.indicators(data, np.array([0, len(data)]))
        before = []
        for model, name in zip(chain.models, chain.categories, strict=True):
            z = model.bias + sum(model.weights[place[int(h)]] for h in own if int(h) in place)
            z += sum(w * p for w, p in zip(model.earlier, before, strict=True))
            before.append(1 / (1 + np.exp(-z)))
            assert abs(before[-1] - r[f"p_{name}"]) < 1e-9


def test_given_words_are_categories(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    chain = T.fit(documents, labels, categories={"insult": ("idiot", "moron"), "rest": ("nowhere",)})
    assert chain.categories == ["insult", "rest", "toxic"]
    assert max(r.p_rest for r in T.score(documents, chain).collect()) < 0.01
