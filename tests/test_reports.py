from pyspark.sql import functions as F

from pagesift.functions.numbers import round_tenth
from pagesift.operators import reports as R
from pagesift.operators.enrich import add_source_columns, shape_sections
from pagesift.sources import outputs as O


def test_round_tenth_is_pythons(spark):
    xs = [a / b * 100 for b in (7, 16, 400, 2000, 3000, 8000) for a in range(b + 1)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    wrong = [r for r in df.select("x", round_tenth(F.col("x")).alias("y")).collect()
             if r.y != round(r.x, 1)]
    assert wrong == []


def test_summaries(spark):
    df = spark.createDataFrame(
        [("u", "A", "t", "xx"), ("u", "A", None, "xxx"), ("u", "B", "t", None), ("v", None, "t", "x")],
        "url string, ai_category string, section_title string, content string",
    )
    got = {(r.url, r.category): (r.section_count, r.total_content_length)
           for r in R.category_summary(df).collect()}
    assert got == {("u", "A"): (1, 5), ("u", "B"): (1, 0)}
    assert [r.n_sections for r in R.category_counts(df).collect()] == [2, 1, 1]
    (row,) = R.filter_summary(df, df.where("content = 'x'")).collect()
    assert tuple(row) == (4, 1, 3, 75.0)
    (row,) = R.filter_summary(df.where("false"), df.where("false")).collect()
    assert tuple(row) == (0, 0, 0, 0.0)
    (row,) = R.run_totals(df.select("url").distinct(), df, df.limit(3)).collect()
    assert tuple(row) == (2, 4, 3, 25)
    (row,) = R.run_totals(df, df.where("false"), df.where("false")).collect()
    assert tuple(row) == (4, 0, 0, 0)


def test_column_widths(spark):
    df = spark.createDataFrame([("x" * 90, "y" * 90, 12345, None)],
                               "content string, url string, row_no int, source_a string")
    got = {r.column_name: r.width for r in R.column_widths(df).collect()}
    assert got == {"content": 82, "url": 42, "row_no": 8, "source_a": 10}


def test_source_columns(spark, as_table):
    sections = as_table(spark.createDataFrame(
        [("a", "t"), ("a", "u"), ("b", "v")], "url string, section_title string"))
    meta = spark.createDataFrame([("a", 1)], "url string, source_rank int")
    shaped = shape_sections(add_source_columns(sections, meta))
    assert shaped.columns == ["url", "source_rank", "page_title", "description", "canonical_url",
                              "section_title", "section_level", "content", "ai_category"]
    got = sorted((r.url, r.section_title, r.source_rank, r.content) for r in shaped.collect())
    assert got == [("a", "t", 1, ""), ("a", "u", 1, ""), ("b", "v", None, "")]
    assert add_source_columns(sections, meta.select("url")) is sections


def test_csv_and_summary(spark, tmp_path):
    df = spark.createDataFrame(
        [(2, "u", 'say "x", y\nz', "B"), (1, "u", " padded ", "A"), (3, "v", "", "A")],
        "pos long, url string, content string, ai_category string",
    ).withColumn("section_title", F.lit("t"))
    path = str(tmp_path / "out.csv")
    O.write_report(df, path, ["pos"], summary=True, drop=("pos",))
    schema = "row_no long, url string, content string, ai_category string, section_title string"
    got = O.read_csv(spark, path, schema).orderBy("row_no").collect()
    assert [(r.row_no, r.content) for r in got] == [
        (1, "padded"), (2, 'say "x", y | z'), (3, "")]
    lines = [x for f in sorted((tmp_path / "out.csv").glob("part-*")) for x in f.read_text().split("\n")]
    assert "3,v,,A,t" in lines and '2,u,"say ""x"", y | z",B,t' in lines
    assert O.summary_path("a/b/out.csv") == "a/b/out_summary.csv"
    assert O.summary_path("out") == "out_summary"
    summary = spark.read.csv(str(tmp_path / "out_summary.csv"), header=True).collect()
    assert sorted((r.row_no, r.url, r.category, r.section_count) for r in summary) == [
        ("1", "u", "A", "1"), ("2", "u", "B", "1"), ("3", "v", "A", "1")]
