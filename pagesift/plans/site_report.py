"""From a URL list and stored pages to a clean, categorised section table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.operators.categorize import (
    CATEGORIES, KEYWORDS, apply_replies, categorize, prompt_batches,
)
from pagesift.operators.enrich import add_source_columns, shape_sections
from pagesift.operators.filters import ORDER, filter_sections
from pagesift.operators.numbering import with_row_number
from pagesift.operators.sections import ERROR_ROW, extract_sections
from pagesift.sources.pages import pages_for_urls
from pagesift.sources.rules import DEFAULT_RULES, FilterRules
from pagesift.sources.staging import stage
from pagesift.sources.urls import submitted_urls


def listed_sections(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections of every listed URL in list order: ``url_no, sec_no, url, ...``.

    A page is split once however often it is listed. Listed URLs without a page
    give one error row each. Pages are restricted to the wanted ids before any of
    their html is looked at; how they are joined is left to Spark's size check.
    """
    listed = stage(pages_for_urls(stage(urls, "urls"), pages), "listed")
    ids = listed.where(F.col("page_id").isNotNull()).select("page_id").distinct()
    needed = pages.join(stage(ids, "wanted"), "page_id", "left_semi")
    sections = extract_sections(needed).drop("url")
    joined = listed.join(sections, "page_id", "left")
    absent = F.col("sec_no").isNull()

    def filled(name: str, stand_in: str):
        return F.when(absent, stand_in).otherwise(F.col(name)).alias(name)

    return joined.select(
        "url_no", F.coalesce("sec_no", F.lit(1)).alias("sec_no"), "url",
        *[filled(c, "") for c in ("page_title", "description", "canonical_url")],
        *[
            filled(c, v)
            for c, v in zip(("section_title", "section_level", "content"), ERROR_ROW)
        ],
    )


def _numbered(sections: DataFrame) -> DataFrame:
    """Staged sections with ``row_no`` in list order, which numbers a classifier's batches."""
    return with_row_number(stage(sections, "sections"), ORDER)


def report_prompts(
    urls: DataFrame, pages: DataFrame, categories: Sequence[str] = CATEGORIES
) -> DataFrame:
    """``(batch_id, n_sections, prompt)`` for the sections of the listed URLs, in list order."""
    return prompt_batches(_numbered(listed_sections(urls, pages)), categories)


def site_report(
    urls: DataFrame,
    pages: DataFrame,
    metadata: DataFrame | None = None,
    rules: FilterRules | None = DEFAULT_RULES,
    keywords: Mapping[str, Sequence[str]] | None = KEYWORDS,
    replies: DataFrame | None = None,
) -> DataFrame:
    """Listed sections, categorised by their raw titles, shaped, and filtered.

    ``replies(batch_id, reply)`` are a classifier's answers to ``report_prompts`` of the
    same URLs and pages; they label all sections before any is filtered, and batches
    without a readable answer go by keyword. ``keywords=None`` without replies leaves the
    category empty, ``rules=None`` skips the filters. The result starts with the order
    columns ``url_no, sec_no``.
    """
    sections = listed_sections(urls, pages)
    if replies is not None:
        sections = apply_replies(_numbered(sections), replies, keywords or KEYWORDS).drop("row_no")
    elif keywords is not None:
        sections = categorize(sections, keywords)
    if metadata is not None:
        sections = add_source_columns(stage(sections, "sections"), metadata)
    shaped = shape_sections(sections, keep=ORDER)
    return shaped if rules is None else filter_sections(shaped, rules)


def submitted_report(texts: DataFrame, text: str, order_by: str, pages: DataFrame) -> DataFrame:
    """The report of URLs typed one per line: invalid lines are left out, the rest is
    normalised; always categorised and filtered, without further columns."""
    return site_report(submitted_urls(texts, text, order_by), pages)
