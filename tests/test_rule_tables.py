"""Rules as a table against a chain of ``contains``."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagesift.functions.text import contains_any
from pagesift.operators import grams as G
from pagesift.operators import rule_tables as RT
from pagesift.operators.filters import keep_rows
from pagesift.sources.rules import DEFAULT_RULES, rules_table


def rows_of(spark, texts):
    data = [(i, None if i % 7 == 0 else f"k{i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "n long, k string, t string").withColumn("a.b", F.lit(1))


def test_against_contains(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abä🙂 .") for _ in range(rng.randint(0, n)))
    texts = [word(60) for _ in range(300)] + [None, "", "a", "ab"]
    rules = [word(9) for _ in range(60)] + ["a", "ab", "ab", None, "🙂🙂", "never there"]
    rows = rows_of(spark, texts)
    some = [r for r in rules if r != ""]
    for own in (some, rules, [], [None]):
        table = spark.createDataFrame([(r,) for r in own], "pattern string")
        got = {tuple(r) for r in RT.rule_hits(rows, ["n", "k"], F.col("t"), table).collect()}
        want = {(i, None if i % 7 == 0 else f"k{i}", r) for i, t in enumerate(texts)
                for r in own if r is not None and r in (t or "")}
        assert got == want
        left = RT.without_rule_hits(rows, ["n", "k"], F.col("t"), table)
        assert left.columns == rows.columns
        assert {r.n for r in left.collect()} == set(range(len(texts))) - {x[0] for x in want}


def test_a_hundred_thousand_rules(spark):
    rng = random.Random(3)
    words = [f"{rng.randrange(10**9)}-{i}" for i in range(100_000)]
    texts = [f"some text with {words[i * 97 % len(words)]} and {i} more" if i % 3 else f"text {i}"
             for i in range(600)]
    rules = spark.createDataFrame([(w,) for w in words], "pattern string")
    rows = rows_of(spark, texts)
    left = RT.without_rule_hits(rows, ["n"], F.col("t"), rules)
    assert {r.n for r in left.collect()} == {i for i in range(600) if i % 3 == 0}
    plan = left._jdf.queryExecution().toString()
    assert len(plan) < 100_000  # no predicate per rule


def test_the_default_rules_as_a_table(spark):
    titles = ["Related Products", "Overview", "News", "More: top RATED things", "a", None]
    contents = ["All rights reserved by us", "five words are in here", "", "subscribe now to it", "x y z", None]
    df = spark.createDataFrame(
        [(i, i, "u", titles[i % 6], "h2", contents[(i // 6) % 6]) for i in range(36)],
        "url_no long, sec_no int, url string, section_title string, section_level string, content string",
    )
    table = rules_table(spark, DEFAULT_RULES)
    got = RT.filter_by_rule_table(df, table)
    want = keep_rows(df, steps=["keyword", "title"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_long_text(spark):
    text = "ab" * 100_000 + "needle"
    rules = spark.createDataFrame([("needle",), ("bab",), ("nowhere",)], "pattern string")
    got = RT.rule_hits(rows_of(spark, [text]), ["n"], F.col("t"), rules)
    assert {r.pattern for r in got.collect()} == {"needle", "bab"}
    assert rows_of(spark, [text]).where(contains_any(F.col("t"), ["needle"])).count() == 1


def test_rules_meet_places_not_texts(spark):
    """Few stretches of a text leave its task, whatever its length; rules may be longer than those."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdeäö🙂 ") for _ in range(n))
    texts = [text(rng.choice([0, 3, 400, 3000])) for _ in range(60)]
    rules = [t[9 : 9 + n] for t, n in zip(texts, [1, 3, 5, 9, 17, 40, 127, 128, 129, 300] * 6) if len(t) > 400]
    rules += [t[:-1] + "?" for t in rules if len(t) > 20]
    rows = rows_of(spark, texts)
    for own in (rules, [r for r in rules if len(r.encode()) <= RT.REACH]):
        hits = RT.rule_hits(rows, ["n"], F.col("t"), spark.createDataFrame([(r,) for r in own], "pattern string"))
        got = [tuple(r) for r in hits.collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(i, r) for i, t in enumerate(texts) for r in own if r in t}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode") == 1 and plan.count("MapInArrow") == 1  # that of repeated keys


def wanted(rows, rules):
    """As many hits of a rule as pairs of rows with the same keys that hold it."""
    held = Counter((k, r) for k, t in rows for r in set(rules) if r and r in (t or ""))
    return Counter({key: n * n for key, n in held.items()})


def test_hits_of_common_rules_are_not_shuffled(spark):
    """Their number grows with rows times rules; before, each of them went through two shuffles."""
    rows = rows_of(spark, [f"the same words in every row {i}" for i in range(200)])
    rules = spark.createDataFrame([(r,) for r in ("the same words in", "words", "ow", "r", "never there")], "pattern string")
    hits = RT.rule_hits(rows, ["n"], F.col("t"), rules)
    assert hits.count() == 800
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()


def test_rows_that_share_their_keys(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abc ") for _ in range(rng.randint(0, n)))
    rows = [(i if i % 3 else (None if i % 2 else -i % 9), text(30)) for i in range(400)]
    rules = [text(6) for _ in range(30)] + ["a", "bc", "abca"]
    df = spark.createDataFrame(rows, "k long, t string")
    table = spark.createDataFrame([(r,) for r in rules if r], "pattern string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys go on in the next batch
    try:
        for keys in (["k"], ["k", "k"]):
            got = Counter((r[0], r.pattern) for r in RT.rule_hits(df, keys, F.col("t"), table).collect())
            assert got == wanted(rows, rules)
        got = Counter(r.pattern for r in RT.rule_hits(df.limit(9), [], F.col("t"), table).collect())
        some = [(None, r.t) for r in df.limit(9).collect()]
        assert got == Counter({r: n for (_, r), n in wanted(some, rules).items()})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_rules_beyond_a_block(spark, monkeypatch):
    """Rules that occur nowhere go first, the others meet the texts block by block."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcä🙂 ") for _ in range(n))
    texts = [text(rng.choice([0, 2, 50, 500])) for _ in range(80)]
    rules = sorted({t[i : i + n] for t in texts for i in (0, 7) for n in (1, 3, 9, 20, 300) if len(t) >= i + n})
    rules += [f"nowhere {i:09d}" for i in range(200)]
    rows, table = rows_of(spark, texts), spark.createDataFrame([(r,) for r in rules], "pattern string")
    monkeypatch.setattr(RT, "BLOCK_RULES", 60)
    hits = RT.rule_hits(rows, ["n"], F.col("t"), table)
    assert Counter(map(tuple, hits.collect())) == wanted(list(enumerate(texts)), rules)
    blocks = hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert 1 < blocks < len(rules) // 60
    monkeypatch.setattr(RT, "BLOCK_RULES", 1 << 20)
    monkeypatch.setattr(RT, "BLOCK_BYTES", 4000)
    assert Counter(map(tuple, RT.rule_hits(rows, ["n"], F.col("t"), table).collect())) == wanted(list(enumerate(texts)), rules)


def test_pieces_of_a_task(monkeypatch):
    """Texts, pairs and hits are cut into pieces of bounded size; nothing depends on where."""
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("aab") for _ in range(rng.randint(0, n)))
    rules = sorted({text(40) for _ in range(300)} - {""})
    rows = [(i // 3 if i < 60 else i, text(200)) for i in range(100)]
    texts = pa.array([t.encode() for _, t in rows], pa.binary())
    new = pa.array([i == 0 or rows[i - 1][0] != k for i, (k, _) in enumerate(rows)])
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), new, texts], names=["_k0", "_new", "_text"])
    listed = pa.RecordBatch.from_arrays([pa.array(rules), pa.array([r.encode() for r in rules], pa.binary())], names=["pattern", "_text"])
    for chunk, step, pairs in ((1 << 20, 1 << 15, 1 << 18), (300, 64, 5), (1, 16, 1)):
        monkeypatch.setattr(RT, "CHUNK", max(chunk, 16 * RT.REACH))
        index = pa.Table.from_batches(list(RT._lister(np.zeros(1 << RT.BUCKETS, np.int64))([listed])))
        for module, name, size in ((RT, "CHUNK", chunk), (G, "STEP", step), (RT, "PAIRS", pairs), (RT, "BATCH", 64 * pairs)):
            monkeypatch.setattr(module, name, size)
        parts = list(RT._finder(["_k0"], RT._Block(index))(batch.slice(i, 9) for i in range(0, 100, 9)))
        assert all(p.num_rows <= max(pairs, 1) for p in parts)
        got = Counter()
        for k, r, n in zip(*(c.to_pylist() for c in pa.Table.from_batches(parts).columns), strict=True):
            got[k, r] += n * n
        assert got == wanted(rows, rules)
