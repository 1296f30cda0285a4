"""Parsed pages in buckets."""

import pytest

from checks.fixtures import layout_pages
from pagesift.operators.sections import container_sections, extract_sections, page_headings
from pagesift.plans.site_report import listed_sections
from pagesift.sources import pages as P
from pagesift.sources.pages import store_pages, stored_pages

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    pages = layout_pages(spark, SMALL)
    table = "stored_for_the_tests"
    yield pages, store_pages(pages, table, 4, str(tmp_path_factory.mktemp("store") / "t"))
    spark.sql(f"DROP TABLE {table}")


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sections_without_a_shuffle(both):
    pages, stored = both
    for extract in (extract_sections, page_headings, container_sections):
        assert "Exchange hash" in plan(extract(pages)) or "Exchange RoundRobin" in plan(extract(pages))
        # A join of a small side may broadcast it.
        assert "Exchange" not in plan(extract(stored)).replace("BroadcastExchange", "")
        assert rows(extract(stored)) == rows(extract(pages))


def test_listed_pages(spark, both):
    pages, stored = both
    urls = spark.createDataFrame(
        [(1, pages.first().url), (2, "https://nowhere.example.com"), (3, pages.first().url)],
        "url_no long, url string",
    )
    assert rows(listed_sections(urls, stored)) == rows(listed_sections(urls, pages))
    assert stored_pages(spark, "stored_for_the_tests").columns == stored.columns


def test_more_buckets_for_more_html(spark, tmp_path, monkeypatch):
    """One task reads a bucket, so its size does not grow with the table."""
    monkeypatch.setattr(P, "BUCKET_CHARS", 1000)
    pages = spark.createDataFrame([(i, f"u{i}", "<h1>a</h1>" + "b " * 400) for i in range(20)], "page_id long, url string, html string")
    store_pages(pages, "many_buckets", 4, str(tmp_path / "t"))
    n = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED many_buckets").collect()}["Num Buckets"]
    spark.sql("DROP TABLE many_buckets")
    assert int(n) == 17
