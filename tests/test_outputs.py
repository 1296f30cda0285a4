"""Parquet files in order."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pagesift.operators import filters as FL
from pagesift.operators import reports as R
from pagesift.sources import outputs as O
from pagesift.sources.outputs import write_parquet, write_report


def test_a_point_read_opens_one_row_group(spark, tmp_path):
    rows = spark.range(4000).select(
        (F.col("id") * 7919 % 1000).alias("url_no"), (F.col("id") % 4).cast("int").alias("sec_no"),
        F.concat(F.lit("https://e.com/"), F.col("id") * 7919 % 1000).alias("url"),
        F.repeat(F.lit("a\nb "), 20).alias("content"),
    )
    path = str(tmp_path / "t.parquet")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # or so few rows are one file
    try:
        write_parquet(rows, path, ["url_no", "sec_no"], rows_per_group=200)
    finally:
        spark.conf.unset(coalesce)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    groups = []
    for file in sorted(tmp_path.glob("t.parquet/*.parquet")):
        meta = pq.ParquetFile(file).metadata
        own = [meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups)]
        assert pq.read_table(file, columns=["url_no", "sec_no"]).sort_by(
            [("url_no", "ascending"), ("sec_no", "ascending")]
        ) == pq.read_table(file, columns=["url_no", "sec_no"])
        groups += [(s.min, s.max, file.name) for s in own]
    assert len(groups) >= 10 and len({f for *_, f in groups}) > 1
    for n in (0, 17, 500, 999):
        files = {f for lo, hi, f in groups if lo <= n <= hi}
        assert len(files) == 1 and sum(lo <= n <= hi for lo, hi, _ in groups) <= 2
        assert back.where(F.col("url") == f"https://e.com/{n}").count() == 4


def test_a_report_in_both_forms(spark, tmp_path):
    rows = spark.range(20).select(
        F.col("id").alias("n"), F.lit("u").alias("url"), F.lit("T").alias("section_title"),
        F.lit("a\nb").alias("content"), F.lit("c").alias("ai_category"),
    )
    write_report(rows, str(tmp_path / "r.csv"), ["n"], parquet=str(tmp_path / "r.parquet"))
    assert {r.content for r in spark.read.parquet(str(tmp_path / "r.parquet")).collect()} == {"a\nb"}
    assert {r.content for r in spark.read.csv(str(tmp_path / "r.csv"), header=True).collect()} == {"a | b"}


def test_table_and_report_from_one_pass(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    titles = F.array(*[F.lit(t) for t in ("News", "Footer", "About us", "Copyright")])
    rows = spark.range(200).select(
        F.col("id").alias("url_no"), F.lit(1).alias("sec_no"), F.lit("u").alias("url"),
        F.get(titles, (F.col("id") % 4).cast("int")).alias("section_title"), F.lit("h2").alias("section_level"),
        counted(F.concat(F.lit("five words and one more "), (F.col("id") % 30).cast("string"))).alias("content"),
        F.lit("Other").alias("kind"),
    )
    kept, report = FL.filter_with_report(rows)
    n = {r.step: r.n_rows for r in report.collect()}
    assert seen.value == 200
    assert n["kept"] == kept.count() and sum(n.values()) == 200
    again = FL.filter_sections(rows)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, again.select(*kept.columns).collect()))
    summary = R.report_summary(report).first()
    assert tuple(summary) == tuple(R.filter_summary(rows, again).first())
    assert tuple(R.report_summary(report.where("false")).first())[:3] == (0, 0, 0)


def test_parts_of_bounded_rows(spark, tmp_path, monkeypatch):
    """A file whose cells may hold line feeds is read by one task."""
    monkeypatch.setattr(O, "FILE_ROWS", 10)
    df = spark.createDataFrame([(i, "a\nb") for i in range(95)], "i int, t string").coalesce(1)
    path = str(tmp_path / "csv")
    O.write_csv(df, path, sort_by="i")
    assert len(list((tmp_path / "csv").glob("part-*.csv"))) >= 10
    back = O.read_csv(spark, path, "i int, t string")
    assert sorted(map(tuple, back.collect())) == [(i, "a\nb") for i in range(95)]
