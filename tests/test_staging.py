from pyspark.sql import functions as F

from pagesift.sources.outputs import write_report
from pagesift.sources.staging import release, remove_staged, stage, staged_in
from pagesift.sources.urls import read_url_csv, url_list, url_metadata


def test_a_folder_of_the_callers_and_its_removal(spark, tmp_path):
    with staged_in(spark, str(tmp_path)):
        table = stage(spark.range(5), "t")
    assert table.count() == 5 and list(tmp_path.iterdir()) == [tmp_path / "pagesift"]
    assert remove_staged(spark, str(tmp_path)) and not list(tmp_path.iterdir())
    assert not remove_staged(spark, str(tmp_path))


def test_a_report_computes_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(50).select(
        counted("id").alias("n"), F.lit("u").alias("url"), F.lit("T").alias("section_title"),
        F.lit("text").alias("content"), (F.col("id") % 3).cast("string").alias("ai_category"),
    )
    write_report(rows, str(tmp_path / "r.csv"), ["n"], summary=True)
    assert seen.value == 50
    numbers = spark.read.csv(str(tmp_path / "r.csv"), header=True, inferSchema=True)
    assert sorted(tuple(r) for r in numbers.select("row_no", "n").collect()) == [
        (i + 1, i) for i in range(50)]


def test_rows_of_several_files_in_order(spark, tmp_path):
    (tmp_path / "part-0.csv").write_text("url,site\na.com,first\n")
    more = "".join(f"b{i}.com,s{i}\n" for i in range(50))
    (tmp_path / "part-1.csv").write_text("url,site\n" + more + "a.com,last\n")
    table = read_url_csv(spark, str(tmp_path))
    urls = [r.url for r in url_list(table, "row_id").orderBy("url_no").collect()]
    assert urls == ["a.com", *[f"b{i}.com" for i in range(50)], "a.com"]
    meta = {r.url: r.source_site for r in url_metadata(table, "row_id").collect()}
    assert meta["a.com"] == "last" and meta["b7.com"] == "s7"


def test_a_table_goes_and_its_shuffle_files_with_it(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with staged_in(spark, str(tmp_path)):
        one = stage(spark.range(50).groupBy((F.col("id") % 7).alias("k")).count(), "one")
        two = stage(one.where("k > 2"), "two")
        assert spark.conf.get(key) == before
        release(one)
    assert two.count() == 4
    assert [p.name[:3] for p in (tmp_path / "pagesift").iterdir()] == ["two"]
