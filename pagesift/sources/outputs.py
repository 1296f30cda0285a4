"""Writing section tables."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.columns import named
from pagesift.functions.text import flatten_newlines
from pagesift.operators.numbering import with_row_number
from pagesift.operators.reports import category_summary
from pagesift.sources.staging import stage

_CSV = {
    "header": True, "quote": '"', "escape": '"', "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}

# Rows of one file: cells may hold line feeds, so a file is read by one task.
FILE_ROWS = 250_000


def export_table(
    df: DataFrame, order_by: list[str], newline: str = " | ", drop: tuple[str, ...] = ()
) -> DataFrame:
    """Adds ``row_no`` as first column and puts every content on one line."""
    numbered = with_row_number(df, order_by).drop(*drop)
    if "content" not in numbered.columns:
        return numbered
    return numbered.withColumn("content", flatten_newlines("content", newline))


def write_csv(df: DataFrame, path: str, sort_by: str | None = None) -> None:
    """A folder of CSV parts with a header.

    What ``export_table`` returns lies in ordered parts and is written as it lies; its
    ``row_no`` says which part comes first. With ``sort_by`` the parts are sorted
    anew and in order one after another. No part has more than ``FILE_ROWS`` rows.
    """
    rows = df.sort(sort_by) if sort_by else df
    rows.write.options(**_CSV, maxRecordsPerFile=FILE_ROWS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reads what ``write_csv`` wrote; empty cells come back as ''."""
    table = spark.read.schema(schema).options(**_CSV, multiLine=True).csv(path)
    texts = {c for c, t in table.dtypes if t == "string"}
    return table.select(
        *[F.coalesce(c, F.lit("")).alias(c) if c in texts else c for c in table.columns]
    )


def write_parquet(
    df: DataFrame, path: str, order_by: list[str], lookup: str | None = "url",
    rows_per_group: int | None = None,
) -> None:
    """Parquet files in ranges of the first order column, sorted inside by all of them.

    Every value of the first order column lies in one file, and the row groups of a file
    in order, so a reader that asks for a range opens only what holds it. ``lookup`` names a
    column in no such order that is asked for by value: its row groups carry Bloom filters.
    """
    options = {}
    if rows_per_group is not None:
        options["parquet.block.row.count.limit"] = str(rows_per_group)
    if lookup in df.columns:
        options[f"parquet.bloom.filter.enabled#{lookup}"] = "true"
    rows = df.repartitionByRange(*named(order_by[:1])).sortWithinPartitions(*named(order_by))
    rows.write.options(**options).parquet(path)


def summary_path(path: str) -> str:
    """``out/report.csv`` gives ``out/report_summary.csv``."""
    name = PurePosixPath(path).name
    stem, suffix = PurePosixPath(name).stem, PurePosixPath(name).suffix
    return path[: len(path) - len(name)] + f"{stem}_summary{suffix}"


def write_report(
    df: DataFrame,
    path: str,
    order_by: list[str],
    categorized: bool = True,
    summary: bool = False,
    drop: tuple[str, ...] = (),
    parquet: str | None = None,
) -> None:
    """The section table, and beside it the category summary if one is asked for.

    ``df`` is computed once and written before anything reads it. ``parquet`` is a second
    place, for the table as it is, with its order columns and line feeds.
    """
    df = stage(df, "report")
    if parquet is not None:
        write_parquet(df, parquet, order_by)
    write_csv(export_table(df, order_by, drop=drop), path)
    if summary and categorized:
        # Both outputs are numbered, the summary by URL and category.
        write_csv(
            export_table(stage(category_summary(df), "summary"), ["url", "category"]),
            summary_path(path),
        )
