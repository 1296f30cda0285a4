"""Repeats within a URL and headings that hold the whole page again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift.functions.columns import named
from pagesift.operators.grams import gram_filter, gram_places
from pagesift.sources.staging import stage

# Levels of sub-sections, and when a first heading counts as a dump.
SUB_LEVELS = ("h2", "h3", "h4", "h5", "h6")
MIN_SUB_SECTIONS = 3
MIN_LENGTH_SHARE = 0.8
LONG_SECTION = 50
PROBE_LENGTH = 100


def first_wins(
    df: DataFrame, order_by: Sequence[str], keys: Sequence[str] = ("url", "content")
) -> DataFrame:
    """The first row of each ``(url, content)`` in the given order.

    Spark turns the rank filter into a group limit before the shuffle as well, so
    however many copies a key has, each task sends at most one row of it. Hashing on
    both keys spreads a URL that holds a great share of the rows. A hash of the keys
    stands before them, so that sorting compares numbers and hardly ever whole texts.
    """
    rank = F.row_number().over(W.partitionBy(F.xxhash64(*keys), *keys).orderBy(*order_by))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def with_probes(sections: DataFrame) -> DataFrame:
    """Adds the length of the content and, for long sub-sections, its opening.

    Kept in a staged table, they let ``page_dumps`` read the contents of ``h1`` rows only.
    """
    is_long_sub = F.col("section_level").isin(*SUB_LEVELS) & (F.length("content") > LONG_SECTION)
    return sections.withColumns(
        {
            "_length": F.length("content").cast("long"),
            "_opening": F.when(is_long_sub, F.substring("content", 1, PROBE_LENGTH)),
        }
    )


def held_openings(heads: DataFrame, openings: DataFrame) -> DataFrame:
    """``(url, _print, _opening, ...)``: the openings that a text of the same URL contains.

    ``heads`` has ``url, _print, content``, ``openings`` has ``url, _opening`` and what else is to
    come with them, each of more than ``LONG_SECTION`` and at most ``PROBE_LENGTH`` characters.
    Texts are hashed where they lie; places that hold as many bytes as the shortest opening
    has, equal to the start of one of the URL, leave the task with the bytes that the longest one may
    take (see ``grams``). The rows grow with the openings found, not with texts times openings.
    """
    start, scope = LONG_SECTION + 1, F.xxhash64("url").alias("_scope")
    listed = stage(
        gram_places(
            openings.withColumns({"_scope": scope, "_text": F.substring(F.col("_opening").cast("binary"), 1, start)}),
            openings.columns, {start: (0, start)}, scoped=True,
        ).drop("_around"),
        "dump-grams",
    )
    longest = listed.agg(F.max(F.octet_length("_opening"))).first()[0] or start  # 4 * PROBE_LENGTH at most
    texts = heads.select("url", "_print", scope, F.col("content").cast("binary").alias("_text"))
    told = gram_filter(listed)
    places = gram_places(texts, ["url", "_print"], {start: (0, longest)}, scoped=True, told=told)
    there = F.startswith("_around", F.col("_opening").cast("binary"))
    met = places.join(listed, ["url", "_gram"]).where(there)
    return met.select("url", "_print", *named(c for c in openings.columns if c != "url")).distinct()


def page_dumps(sections: DataFrame) -> DataFrame:
    """The ``h1`` rows that repeat the page: a subset of ``sections``, all columns.

    An ``h1`` is a dump if its URL has at least three sub-sections, its text is
    longer than 0.8 of theirs together, and it holds the first 100 characters of
    at least half of them (only those of more than 50 characters can count).

    ``sections`` should be a table. The lengths are compared before any text moves:
    where an ``h1`` can still be a dump, the sub-sections of its URL together are
    shorter than 1.25 times that ``h1``, which bounds the openings of a URL whatever
    number of rows it has. Equal openings, and equal texts of a URL, are looked for once.
    """
    probed = sections if "_opening" in sections.columns else with_probes(sections)
    is_sub, length = F.col("section_level").isin(*SUB_LEVELS), F.col("_length")
    share = F.lit(MIN_LENGTH_SHARE)
    numbers = (
        probed.where(is_sub | (F.col("section_level") == "h1"))
        .groupBy("url")
        .agg(
            F.count_if(is_sub).alias("_n_sub"),
            F.sum(F.when(is_sub, length).otherwise(0)).alias("_sub_length"),
            F.max(F.when(~is_sub, length)).alias("_h1_length"),
        )
        .where(
            (F.col("_n_sub") >= MIN_SUB_SECTIONS)
            & (F.col("_h1_length") > F.col("_sub_length") * share)
        )
        .drop("_h1_length")
    )
    numbers = stage(numbers, "dump-numbers")
    starts = probed.where(F.col("_opening").isNotNull()).select("url", "_opening")
    openings = stage(
        starts.join(numbers.select("url"), "url", "left_semi")
        .groupBy("url", "_opening").agg(F.count("*").alias("_n")),
        "dump-openings",
    )
    heads = (
        probed.where((F.col("section_level") == "h1") & (F.col("content") != "")).drop("_opening")
        .join(numbers, "url").where(length > F.col("_sub_length") * share)
        .withColumn("_print", F.md5("content"))
    )
    heads = stage(heads, "dump-heads")
    once = heads.select("url", "_print", "content").dropDuplicates(["url", "_print"])
    held = held_openings(once, openings).groupBy("url", "_print").agg(F.sum("_n").alias("_held"))
    return (
        heads.join(stage(held, "dump-counts"), ["url", "_print"])
        .where(2 * F.col("_held") >= F.col("_n_sub"))
        .withColumn("_opening", F.lit(None).cast("string"))
        .select(*named(sections.columns))
    )


def remove_page_dumps(sections: DataFrame) -> DataFrame:
    """Drops every row that shares URL, title and level with a page dump.

    Dumps are of level ``h1``, so no other rows need to be compared with them.
    """
    keys = ["url", "section_title", "section_level"]
    doomed = stage(page_dumps(sections).select(*keys).distinct(), "dumps")
    rows = sections.select(*named(c for c in sections.columns if c not in ("_length", "_opening")))
    is_head = F.coalesce(F.col("section_level") == "h1", F.lit(False))
    return rows.where(~is_head).unionByName(rows.where(is_head).join(doomed, keys, "left_anti").select(*named(rows.columns)))
