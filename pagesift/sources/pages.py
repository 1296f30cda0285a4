"""Stored pages: which one belongs to which listed URL, and a layout to read them from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.urls import normalize_url
from pagesift.operators.sections import PARSED, parse_pages

BUCKET_CHARS = 1 << 26


def pages_for_urls(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """``(url_no, url, page_id)``: one row per listed URL, repeats included.

    URLs are matched after normalising; the URL stays as it was listed. ``page_id``
    is null where no page is stored, and the lowest one where several are. Only ids and
    addresses are read here, no html, and only those of listed URLs are aggregated.
    ``urls`` should be a table, as it is read twice.
    """
    listed = urls.withColumn("_key", normalize_url("url"))
    stored = pages.select(normalize_url("url").alias("_key"), "page_id")
    known = (
        stored.join(listed.select("_key").distinct(), "_key", "left_semi")
        .groupBy("_key").agg(F.min("page_id").alias("page_id"))
    )
    return listed.join(known, "_key", "left").select("url_no", "url", "page_id")


def store_pages(pages: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Parsed pages as a table of ``buckets`` by ``page_id``, sorted inside; returns it.

    Pages are parsed once, however many reports read them, and wherever this table
    stands for ``pages``, lookups by id and all windows over a page's pieces run where its
    bucket lies: sections are extracted without a shuffle. One task reads a bucket, so
    there are more than ``buckets`` where one would get more than ``BUCKET_CHARS`` of html.
    ``path`` is a folder that all executors share; without one the table is kept by the catalog.
    """
    if "html" in pages.columns:
        chars = pages.agg(F.sum(F.length("html"))).first()[0] or 0
        buckets = max(buckets, -(-chars // BUCKET_CHARS))
    rows = parse_pages(pages).select(*PARSED).repartition(buckets, "page_id")
    writer = rows.write.bucketBy(buckets, "page_id").sortBy("page_id")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return stored_pages(pages.sparkSession, table)


def stored_pages(spark: SparkSession, table: str) -> DataFrame:
    """A table that ``store_pages`` made, for every function that takes pages."""
    return spark.table(table).select(*PARSED)
