import random

from pyspark.sql import functions as F

from pagesift.operators import numbering as N


def test_row_numbers_are_dense_and_in_order(spark):
    keys = random.Random(1).sample(range(10**9), 5000)
    df = spark.createDataFrame([(k // 7, k % 7) for k in keys], "a long, b long").repartition(7)
    got = N.with_row_number(df, ["a", "b"]).orderBy("row_no").collect()
    assert [r.row_no for r in got] == list(range(1, 5001))
    assert [(r.a, r.b) for r in got] == sorted((k // 7, k % 7) for k in keys)


def test_row_numbers_of_nothing(spark):
    df = spark.range(5).where("id > 9")
    assert N.with_row_number(df, ["id"]).count() == 0


def test_page_breaks_across_blocks(spark):
    n = 3 * 65536 + 10
    df = spark.range(1, n + 1).select(
        F.col("id").alias("row_no"), (F.col("id") / 1000).cast("long").cast("string").alias("url")
    )
    got = {r.row_no for r in N.mark_page_breaks(df).where("is_break").collect()}
    assert got == {i for i in range(2, n + 1) if i // 1000 != (i - 1) // 1000}
    assert N.mark_page_breaks(df).count() == n
    # a change exactly between two blocks, and none after an empty url
    edge = spark.createDataFrame(
        [(65536, "a"), (65537, "b"), (65538, ""), (65539, "c")], "row_no long, url string"
    )
    assert [r.row_no for r in N.mark_page_breaks(edge).where("is_break").collect()] == [65537, 65538]
