"""Filter rules as plain values and as a table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES_SCHEMA = "rule_type string, ord int, pattern string"


@dataclass(frozen=True)
class FilterRules:
    """What to drop. Keywords and titles are matched as written against lower-cased text."""

    min_word_count: int
    excluded_categories: tuple[str, ...]
    excluded_section_titles: tuple[str, ...]
    boilerplate_keywords: tuple[str, ...]
    boilerplate_phrases: tuple[str, ...]


# The rules that apply where no rule set is given for a key.
FALLBACK_RULES = FilterRules(
    min_word_count=5,
    excluded_categories=(
        "Legal/Terms/Privacy", "Contact Information", "Navigation/Menu", "Other",
    ),
    excluded_section_titles=(
        "related products", "you may also like", "customers also bought",
        "similar products", "recently viewed", "recommended for you", "footer", "sitemap",
    ),
    boilerplate_keywords=(
        "copyright", "all rights reserved", "privacy policy", "terms and conditions",
    ),
    boilerplate_phrases=(r"Loading\.\.\.", r"Click here", r"Read more"),
)

# The rule set used unless the caller passes one.
DEFAULT_RULES = FilterRules(
    min_word_count=5,
    excluded_categories=(
        "Legal/Terms/Privacy", "Contact Information", "Navigation/Menu", "Other",
    ),
    excluded_section_titles=(
        "related products", "you may also like", "customers also bought",
        "similar products", "recently viewed", "recommended for you",
        "people also viewed", "best sellers", "top rated", "featured products",
        "more from this category", "compare products", "add to cart", "add to wishlist",
        "share this", "follow us", "social media", "get in touch", "important links",
        "quick links", "useful links", "footer", "site map", "sitemap",
    ),
    boilerplate_keywords=(
        "copyright", "all rights reserved", "developed by", "w3 total cache",
        "terms & conditions", "terms and conditions", "subscribe", "newsletter",
        "email address", "cookie policy", "privacy policy", "powered by", "built with",
        "website by", "designed by",
    ),
    boilerplate_phrases=(
        r"Loading\.\.\.", r"Please wait\.\.\.", r"Click here", r"Read more",
        r"Learn more", r"View all", r"See more", r"Show more", r"Back to top",
        r"Scroll to top", r"Skip to content", r"Skip to main content",
        r"/\$[^$]*\$", r"Anchor \d+", r"\$w\s*\.", r"\$\s*\$",
        r"Accept cookies", r"We use cookies", r"This website uses cookies",
    ),
)


def rules_table(
    spark: SparkSession, rules: FilterRules | Mapping[str, object]
) -> DataFrame:
    """One row per rule. A mapping may hold only some of the keys."""
    given = rules if isinstance(rules, Mapping) else vars(rules)
    rows = []
    for key, value in given.items():
        items = [str(value)] if key == "min_word_count" else list(value)
        rows += [(key, i, item) for i, item in enumerate(items)]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def overlay_rules(user: DataFrame, defaults: DataFrame) -> DataFrame:
    """A rule type the user gives replaces the default one whole; others stay."""
    kept = defaults.join(user.select("rule_type").distinct(), "rule_type", "left_anti")
    return user.select("rule_type", "ord", "pattern").unionByName(
        kept.select("rule_type", "ord", "pattern")
    )


def rules_from_table(table: DataFrame) -> FilterRules:
    """Read a rule table into plan parameters (a rule set is configuration, not data).

    Rule types without a row have the fallback, as in ``rules_of``.
    """
    by_type: dict[str, list[str]] = {}
    known = table.where(F.col("rule_type").isin([f.name for f in fields(FilterRules)]))
    for row in known.orderBy("rule_type", "ord").toLocalIterator():
        by_type.setdefault(row.rule_type, []).append(row.pattern)
    words = by_type.pop("min_word_count", None)
    return rules_of(by_type | ({"min_word_count": words[0]} if words else {}))


def rules_of(config: Mapping[str, object]) -> FilterRules:
    """A parsed rule file with the fallback filled in for every key it lacks."""
    picked = {}
    for f in fields(FilterRules):
        value = config.get(f.name, getattr(FALLBACK_RULES, f.name))
        picked[f.name] = int(value) if f.name == "min_word_count" else tuple(value)
    return FilterRules(**picked)
