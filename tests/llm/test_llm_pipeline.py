import corpus_pipeline as C
from checks.compare import compare, duck
from checks.registry import ORACLES, QUERIES
from pagesift.llm import quality
from pagesift.llm.queries import ORACLES as LLM_ORACLES
from pagesift.llm.queries import QUERIES as LLM_QUERIES
from tests.llm.test_llm_jaccard import brute as jaccard_brute
from tests.llm.test_llm_layout import check_packed
from tests.llm.test_llm_lines import brute as lines_brute

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, documents, as_table):
    docs, seen = documents, []
    for name, apply in C.STAGES:
        docs = as_table(apply(spark, docs, SMALL), name)
        seen.append(docs)
    assert all(d.columns == documents.columns for d in seen[:-1])
    good, lines, one, clean, packed = seen
    model = quality.fit(documents, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = {r.doc_id for r in quality.score(documents, model).where("score >= 0.5").collect()}
    assert {r.doc_id for r in good.collect()} == want and 0 < len(want) < 200
    texts = lines_brute([(r.doc_id, r.text) for r in good.collect()])
    assert {r.doc_id: r.text for r in lines.collect()} == texts
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    groups = jaccard_brute(texts.items(), 80, 100, 5)
    assert {r.doc_id for r in one.collect()} == {d for d, g in groups.items() if g[1] == d}
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in clean.collect()}
    gone = [r.text for r in one.collect() if r.doc_id not in left]
    assert gone and not any(i in t for t in left.values() for i in items)
    assert check_packed(packed.collect(), left) > 0.95


def test_run_gives_the_last_stage(spark):
    out = C.run(spark, SMALL)
    assert "sequence_id" in out.columns and out.count() > 0


def test_stages_of_an_empty_table(spark, documents):
    docs = documents.where("false")
    for _, apply in C.STAGES:
        docs = apply(spark, docs, SMALL)
        assert docs.count() == 0


def test_registered_queries(spark):
    import __spark_entry__ as entry

    assert set(LLM_QUERIES) | {"pipeline"} <= set(entry.queries())
    assert not set(LLM_QUERIES) & set(QUERIES)
    assert {n.split("_")[0] for n in LLM_QUERIES} == {f"op{n}" for n in range(1, 14)}
    con = duck(SMALL)
    for name in LLM_ORACLES:
        QUERIES[name], ORACLES[name] = LLM_QUERIES[name], LLM_ORACLES[name]
        try:
            ok, note = compare(spark, con, name, SMALL)
        finally:
            del QUERIES[name], ORACLES[name]
        assert ok, note


def test_rows_without_an_id_or_of_one_id_are_rows_of_their_own(spark, documents):
    copied, alone, other = (f"{w} " + " ".join(f"{w}{i}" for i in range(40)) for w in ("ab", "cd", "ef"))
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    rows = [(3, copied), (7, copied), (7, alone), (None, other), (None, other), (None, copied),
            (3, copied), (8, item), (8, "clean eight"), (None, item), (None, "clean none"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = C.one_of_each(spark, docs, SMALL)
    key = lambda x: (str(x[0]), str(x[1]))
    want = [(3, copied), (7, alone), (None, other), (8, item), (8, "clean eight"),
            (None, "clean none"), (9, None)]
    assert sorted(map(tuple, one.collect()), key=key) == sorted(want, key=key)
    clean = C.no_benchmark(spark, docs, SMALL)
    assert sorted(map(tuple, clean.collect()), key=key) == sorted(
        (r for r in rows if r[1] != item), key=key
    )


def test_columns_of_any_name_come_through(spark, documents, edges, as_table):
    own = {"a.b": "1", "score": "2", "n_lines": "3", "N_Removed": "4", "_row": "5", "_group": "6", "id": "7"}
    docs = documents.limit(60)
    for name, value in own.items():
        docs = docs.withColumn(name, quality.F.lit(value))
    docs = docs.unionByName(
        edges.select("doc_id", "text", "lang", "source", "n_chars", *[
            quality.F.lit(v).alias(k) for k, v in own.items()]))
    columns = docs.columns
    for name, apply in C.STAGES[:-1]:
        docs = as_table(apply(spark, docs, SMALL), name)
        assert docs.columns == columns
    rows = docs.collect()
    assert rows and all([r[k] for k in own] == list(own.values()) for r in rows)
    assert C.packed(spark, docs, SMALL).where("start = 0").count() == len(rows)


def test_run_leaves_what_its_result_reads(spark, tmp_path):
    from pagesift.sources.staging import staged_in

    with staged_in(spark, str(tmp_path)):
        out = C.run(spark, SMALL)
    left = [p.name for p in (tmp_path / "pagesift").iterdir() if any(p.iterdir())]
    assert sorted(n.rsplit("-", 1)[0] for n in left) == ["pipeline-packing"]
    assert out.count() > 0
