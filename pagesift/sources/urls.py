"""URL lists: from tables, CSV files and free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.columns import named
from pagesift.functions.text import strip
from pagesift.functions.urls import is_valid_url, normalize_url
from pagesift.operators.numbering import with_row_number
from pagesift.sources.csv_records import read_csv_records
from pagesift.sources.staging import stage

# The column names tried, in order, after the requested one.
URL_COLUMNS = ("url", "link", "website")


# Cells of a CSV file that mean there is no value.
MISSING = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_url_csv(
    spark: SparkSession, path: str, order: str = "row_id", multiline: bool = False
) -> DataFrame:
    """CSV files with a header row, types inferred, and their row order as a column.

    The order is that of the files' paths and of the rows in each, counted from 1; Spark
    itself reads files largest first. ``multiline`` allows line feeds in quoted cells,
    of files of any size; see ``csv_records``.
    """
    if multiline:
        scan, place = read_csv_records(spark, path)  # of files that were written for it
        table = scan
    else:
        options = {"header": True, "inferSchema": True, "quote": '"', "escape": '"'}
        scan, place = spark.read.options(**options).csv(path), ("_file", "_block", "_row")
        table = stage(
            scan.select(
                *named(scan.columns), F.col("_metadata.file_path").alias(place[0]),
                F.col("_metadata.file_block_start").alias(place[1]),
                F.monotonically_increasing_id().alias(place[2]),
            ),
            "url-csv",
        )
    kinds = [(c, t) for c, t in scan.dtypes if c not in place]
    table = with_row_number(table, place, order).drop(*place)
    cells = [
        F.when(~col.isin(*MISSING), col).alias(c) if t == "string" else col
        for (c, t), col in zip(kinds, named(c for c, _ in kinds))
    ]
    return table.select(order, *cells)


def resolve_url_column(columns: list[str], wanted: str = "url") -> str:
    """The column that holds the URLs; the first one if no name matches.

    Names are compared without case; of names that differ only by case the last wins.
    """
    by_lower = {c.lower(): c for c in columns}
    for name in (wanted.lower(), *URL_COLUMNS):
        if name in by_lower:
            return by_lower[name]
    return columns[0]


def url_list(table: DataFrame, order_by: str, wanted: str = "url") -> DataFrame:
    """``(url_no, url)``: trimmed, blanks and nulls dropped, repeats kept.

    ``order_by`` is the integer column that says in which order the rows came.
    """
    column = resolve_url_column([c for c in table.columns if c != order_by], wanted)
    url = strip(named([column])[0].cast("string"))
    return table.select(F.col(order_by).cast("long").alias("url_no"), url.alias("url")).where(
        F.col("url") != ""
    )


def url_metadata(table: DataFrame, order_by: str, wanted: str = "url") -> DataFrame:
    """One row per URL with every other column, named ``source_*``; the last row wins.

    Of columns that get the same name the last one stays.
    """
    columns = [c for c in table.columns if c != order_by]
    column = resolve_url_column(columns, wanted)
    others = [c for c in columns if c != column]
    sources = {
        "source_" + c.lower().replace(" ", "_"): col for c, col in zip(others, named(others))
    }
    rows = table.select(
        strip(named([column])[0].cast("string")).alias("url"),
        F.col(order_by).cast("long").alias("url_no"),
        F.struct(F.lit(1).alias("_"), *[c.alias(n) for n, c in sources.items()]).alias("meta"),
    ).where(F.col("url") != "")
    last = rows.groupBy("url").agg(F.max_by("meta", "url_no").alias("meta"))
    return last.select("url", "meta.*").drop("_")


def urls_from_text(texts: DataFrame, text: str, order_by: str) -> DataFrame:
    """One row per non-blank line of a text column, trimmed: ``(order_by, line_no, url)``."""
    lines = texts.select(
        order_by, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")
    )
    return lines.select(order_by, "line_no", strip("line").alias("url")).where(F.col("url") != "")


def route_urls(urls: DataFrame) -> DataFrame:
    """Adds ``is_valid`` and, for valid rows, the normalised address as ``target``."""
    routed = urls.withColumn("is_valid", is_valid_url("url"))
    return routed.withColumn("target", F.when(F.col("is_valid"), normalize_url("url")))


def route_counts(urls: DataFrame) -> DataFrame:
    return route_urls(urls).groupBy("is_valid").agg(F.count("*").alias("n_urls"))


def submitted_urls(texts: DataFrame, text: str, order_by: str) -> DataFrame:
    """``(url_no, url)`` of the valid lines of a text column, normalised, in line order."""
    lines = urls_from_text(texts, text, order_by)
    routed = route_urls(with_row_number(lines, [order_by, "line_no"], "url_no"))
    return routed.where("is_valid").select("url_no", F.col("target").alias("url"))
