"""Counts and summaries of section tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.columns import named
from pagesift.functions.numbers import round_tenth

# The widest a column may be shown, by name and otherwise, and its margin.
WIDE_COLUMNS = ("content", "description")
WIDE_CAP, CAP, MARGIN = 80, 40, 2


def category_summary(sections: DataFrame) -> DataFrame:
    """Sections and characters of content per URL and category."""
    return (
        sections.where(F.col("url").isNotNull() & F.col("ai_category").isNotNull())
        .groupBy("url", F.col("ai_category").alias("category"))
        .agg(
            F.count("section_title").alias("section_count"),
            F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("total_content_length"),
        )
    )


def category_counts(sections: DataFrame) -> DataFrame:
    """Sections per category, most frequent first."""
    counts = sections.groupBy("ai_category").agg(F.count("*").alias("n_sections"))
    return counts.orderBy(F.desc("n_sections"), "ai_category")


def _counted(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    parts = [
        t.agg(*[(F.count("*") if n == name else F.lit(0).cast("long")).alias(n) for n in tables])
        for name, t in tables.items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.agg(*[F.sum(n).alias(n) for n in tables])


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(0.0)


def filter_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before, after and removed, and the percentage removed to one decimal."""
    return _removal(_counted(original_rows=before, filtered_rows=after))


def report_summary(report: DataFrame) -> DataFrame:
    """``filter_summary`` from the report of ``filter_with_report``: no table is counted again."""
    n = report.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("original_rows"),
        F.coalesce(F.sum(F.when(F.col("step") == "kept", F.col("n_rows"))), F.lit(0))
        .alias("filtered_rows"),
    )
    return _removal(n)


def _removal(n: DataFrame) -> DataFrame:
    removed = F.col("original_rows") - F.col("filtered_rows")
    percentage = _share(removed, F.col("original_rows")) * 100
    return n.select(
        "original_rows", "filtered_rows", removed.alias("removed_rows"),
        round_tenth(percentage).alias("removal_percentage"),
    )


def run_totals(urls: DataFrame, sections: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: URLs, sections found, sections kept, and the whole percentage of noise."""
    n = _counted(n_urls=urls, n_sections=sections, n_kept=kept)
    found = F.col("n_sections")
    noise = F.bround((1 - _share(F.col("n_kept"), found)) * 100, 0).cast("long")
    return n.select("*", F.when(found > 0, noise).otherwise(0).alias("noise_percentage"))


def column_widths(table: DataFrame) -> DataFrame:
    """``(column_name, width)``: longest cell or name, capped, plus a margin."""
    longest = table.agg(
        *[F.max(F.coalesce(F.length(col.cast("string")), F.lit(3))).alias(c)
          for c, col in zip(table.columns, named(table.columns))]
    )
    rows = []
    for c, col in zip(table.columns, named(table.columns)):
        cap = WIDE_CAP if c in WIDE_COLUMNS else CAP
        longest_cell = F.coalesce(col, F.lit(0))
        width = F.least(F.greatest(longest_cell, F.lit(len(c))), F.lit(cap)) + MARGIN
        rows.append(F.struct(F.lit(c).alias("column_name"), width.alias("width")))
    return longest.select(F.inline(F.array(*rows)))
