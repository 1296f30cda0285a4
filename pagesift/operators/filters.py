"""Row filters over section tables, and the report of what each step removed.

A section table has ``url, section_title, section_level, content``, optionally
``ai_category``, and integer order columns that identify a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.columns import named
from pagesift.functions.text import clean_text, contains_any, strip_phrases
from pagesift.operators.dedup import first_wins, remove_page_dumps, with_probes
from pagesift.sources.rules import DEFAULT_RULES, FilterRules
from pagesift.sources.staging import stage

# Rating words a product link may add to its title, in removal order.
RATING_WORDS = ("good", "better", "best", "new")

ORDER = ("url_no", "sec_no")

# Names of the steps, in the order in which they apply.
STEPS = ("category", "keyword", "title", "product_link", "words", "duplicate", "page_dump")


def freeze(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` through a generator, so that each new column is computed once.

    The optimizer pushes a filter below a projection by copying the projected
    expression into every predicate that names it; a chain of regexes would run
    dozens of times per row. It cannot push one below a generator.
    """
    others = [c for c in df.columns if c not in columns]
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    out = df.select(*named(others), F.inline(F.array(made)))
    new = [c for c in columns if c not in df.columns]
    return out.select(*named(df.columns), *new)


def clean_sections(df: DataFrame, rules: FilterRules = DEFAULT_RULES) -> DataFrame:
    """Cleaned title and content; boilerplate phrases leave the content only."""
    plain = freeze(
        df, section_title=clean_text("section_title"), content=clean_text("content")
    )
    low = freeze(plain, _low=F.lower("content"))
    stripped = strip_phrases(
        "content", rules.boilerplate_phrases, collapsed=True, lowered=F.col("_low")
    )
    return freeze(low, content=stripped).drop("_low")


def has_excluded_category(category: Column, rules: FilterRules) -> Column:
    """Written so that its negation can go down to the scan."""
    return category.isNotNull() & category.isin(*rules.excluded_categories)


def has_boilerplate_keyword(lower_text: Column, rules: FilterRules) -> Column:
    """For title and content with a blank between them: a keyword may stand across it."""
    return contains_any(lower_text, rules.boilerplate_keywords)


def has_excluded_title(lower_title: Column, rules: FilterRules) -> Column:
    return contains_any(lower_title, rules.excluded_section_titles)


def is_product_link(lower_title: Column, lower_content: Column) -> Column:
    """The content says little more than the title: the title of a link to a product."""
    bare = lower_content
    for word in RATING_WORDS:
        bare = F.replace(bare, F.lit(word), F.lit(""))
    short = F.length(lower_content) < 2 * F.length(lower_title)
    return (
        (lower_title != "")
        & (lower_content != "")
        & ((lower_content.contains(lower_title) & short) | (F.trim(bare) == lower_title))
    )


def has_too_few_words(content: Column, rules: FilterRules) -> Column:
    """For cleaned content, where every word but the first follows one blank."""
    blanks = F.length(content) - F.length(F.translate(content, " ", ""))
    n_words = F.when(content == "", 0).otherwise(blanks + 1)
    return n_words < rules.min_word_count


def _lowered(cleaned: DataFrame) -> DataFrame:
    lower = freeze(cleaned, _title=F.lower("section_title"), _content=F.lower("content"))
    return freeze(lower, _both=F.concat("_title", F.lit(" "), "_content"))


def _row_tests(df: DataFrame, rules: FilterRules) -> list[tuple[str, Column]]:
    tests = []
    if "ai_category" in df.columns:
        tests.append(("category", has_excluded_category(F.col("ai_category"), rules)))
    return tests + [
        ("keyword", has_boilerplate_keyword(F.col("_both"), rules)),
        ("title", has_excluded_title(F.col("_title"), rules)),
        ("product_link", is_product_link(F.col("_title"), F.col("_content"))),
        ("words", has_too_few_words(F.col("content"), rules)),
    ]


def keep_rows(
    df: DataFrame,
    rules: FilterRules = DEFAULT_RULES,
    steps: Sequence[str] = STEPS,
) -> DataFrame:
    """Cleaned rows that pass the row-local ``steps``."""
    cleaned = clean_sections(df, rules)
    tested = _lowered(cleaned)
    for step, fails in _row_tests(df, rules):
        if step in steps:
            tested = tested.where(~fails)
    return tested.select(*named(cleaned.columns))


def filter_sections(
    df: DataFrame,
    rules: FilterRules = DEFAULT_RULES,
    order_by: Sequence[str] = ORDER,
) -> DataFrame:
    """Clean, apply every row filter, drop repeats within a URL, drop page dumps."""
    unique = first_wins(keep_rows(df, rules), order_by)
    return remove_page_dumps(stage(with_probes(unique), "unique"))


def with_drop_reason(df: DataFrame, rules: FilterRules = DEFAULT_RULES) -> DataFrame:
    """Cleaned rows with ``drop_reason``: the first row-local step each fails, or null."""
    cleaned = clean_sections(df, rules)
    tested = _lowered(cleaned)
    reason = F.lit(None).cast("string")
    for step, fails in reversed(_row_tests(df, rules)):
        reason = F.when(fails, step).otherwise(reason)
    return freeze(tested, drop_reason=reason).select(*named(cleaned.columns), "drop_reason")


def filter_with_report(
    df: DataFrame,
    rules: FilterRules = DEFAULT_RULES,
    order_by: Sequence[str] = ORDER,
) -> tuple[DataFrame, DataFrame]:
    """What ``filter_sections`` keeps, and ``(step, n_rows)``: what each step removed.

    The texts are cleaned and tested in one pass, which writes every row with the step it
    failed at (the texts only of rows that failed none); table and report both come from
    that. Counters of the tasks themselves would save the column, but they count again
    what is repeated when an executor with shuffle files is lost. Under ``kept`` the report
    has the rows that stay; steps that remove nothing have a row with 0.
    """
    reasoned = with_drop_reason(df, rules)
    alive = F.col("drop_reason").isNull()
    texts = ("section_title", "content")
    staged = stage(
        reasoned.select(
            *[F.when(alive, F.col(c)).alias(c) if c in texts else named([c])[0]
              for c in reasoned.columns]
        ),
        "reasons",
    )
    count = F.count("*").alias("n")
    local = staged.groupBy(F.coalesce("drop_reason", F.lit("alive")).alias("step")).agg(count)
    first = first_wins(staged.where(alive).drop("drop_reason"), order_by)
    unique = stage(with_probes(first), "unique")
    n_unique = unique.agg(F.lit("unique").alias("step"), count)
    kept = stage(remove_page_dumps(unique), "kept")
    n_kept = kept.agg(F.lit("kept").alias("step"), count)
    known = local.unionByName(n_unique).unionByName(n_kept)
    # One row of at most eight counts; the last steps are differences of totals.
    totals = known.groupBy().pivot("step", ["alive", "unique", "kept", *STEPS[:5]]).agg(F.sum("n"))
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in totals.columns}
    n["duplicate"] = n["alive"] - n["unique"]
    n["page_dump"] = n["unique"] - n["kept"]
    rows = [F.struct(F.lit(s).alias("step"), n[s].alias("n_rows")) for s in (*STEPS, "kept")]
    return kept, totals.select(F.inline(F.array(*rows)))


def step_report(
    df: DataFrame,
    rules: FilterRules = DEFAULT_RULES,
    order_by: Sequence[str] = ORDER,
) -> DataFrame:
    """``(step, n_rows)`` alone; see ``filter_with_report``."""
    return filter_with_report(df, rules, order_by)[1]
