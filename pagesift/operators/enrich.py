"""Section tables in their published shape, with what the URL list says about each URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions.columns import named
from pagesift.functions.text import text_or_empty

# The columns of a published section table, in order.
META_COLUMNS = ("page_title", "description", "canonical_url")
SECTION_COLUMNS = ("section_title", "section_level", "content", "ai_category")


def shape_sections(sections: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fixed column order, missing texts as '', after any ``keep`` columns such as the order."""
    given = dict(zip(sections.columns, named(sections.columns)))
    source = [c for c in sections.columns if c.startswith("source_")]
    texts = [*META_COLUMNS, *SECTION_COLUMNS]
    return sections.select(
        *keep, "url", *named(source),
        *[text_or_empty(given.get(c, F.lit(None))).alias(c) for c in texts],
    )


def add_source_columns(sections: DataFrame, metadata: DataFrame) -> DataFrame:
    """Joins the ``source_*`` columns of ``metadata`` by URL; unknown URLs get nulls.

    ``metadata`` grows with the URL list, so whether it is broadcast is left to Spark's
    size check; a URL with very many rows is on the left, where adaptive execution splits it.
    """
    if len(metadata.columns) < 2:
        return sections
    return sections.join(metadata, ["url"], "left")
