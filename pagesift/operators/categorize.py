"""Section categories: by keyword, or through an outside classifier's replies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.columns import named
from pagesift.functions.text import contains_any, strip, text_or_empty

# The categories offered to a classifier.
CATEGORIES = (
    "About/Company Overview", "Products/Services", "Features/Capabilities", "Pricing/Plans",
    "Testimonials/Reviews", "Contact Information", "FAQ/Help", "Blog/News/Articles",
    "Team/Leadership", "Careers/Jobs", "Legal/Terms/Privacy", "Case Studies/Portfolio",
    "Partners/Integrations", "Resources/Downloads", "Getting Started/How It Works", "Other",
)

# Words that put a title into a category; the first category that has one wins.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "About/Company Overview": ("about", "who we are", "our story", "mission", "vision", "company"),
    "Products/Services": ("product", "service", "solution", "offering"),
    "Features/Capabilities": ("feature", "capability", "benefit", "why choose"),
    "Pricing/Plans": ("price", "pricing", "plan", "cost", "subscription"),
    "Testimonials/Reviews": ("testimonial", "review", "customer", "client", "success"),
    "Contact Information": ("contact", "reach", "email", "phone", "location", "address"),
    "FAQ/Help": ("faq", "question", "help", "support", "how to"),
    "Blog/News/Articles": ("blog", "news", "article", "post", "update"),
    "Team/Leadership": ("team", "leadership", "founder", "people", "staff"),
    "Careers/Jobs": ("career", "job", "hiring", "work with us", "join"),
    "Legal/Terms/Privacy": ("legal", "terms", "privacy", "policy", "cookie"),
    "Case Studies/Portfolio": ("case study", "portfolio", "project", "work"),
    "Partners/Integrations": ("partner", "integration", "connect"),
    "Resources/Downloads": ("resource", "download", "guide", "whitepaper", "ebook"),
    "Getting Started/How It Works": ("getting started", "how it works", "start", "begin"),
}

OTHER = "Other"
BATCH_SIZE = 20
PREVIEW_LENGTH = 200


def keyword_category(
    title: Column | str, keywords: Mapping[str, Sequence[str]] = KEYWORDS
) -> Column:
    """First category with a keyword inside the lower-cased title, else ``Other``."""
    lower = F.lower(text_or_empty(title))
    out = F.lit(OTHER)
    for category, words in reversed(keywords.items()):
        out = F.when(contains_any(lower, words), category).otherwise(out)
    return out


def categorize(
    sections: DataFrame, keywords: Mapping[str, Sequence[str]] = KEYWORDS
) -> DataFrame:
    return sections.withColumn("ai_category", keyword_category("section_title", keywords))


def with_batch(numbered: DataFrame, row_no: str = "row_no") -> DataFrame:
    """Adds ``batch_id`` and ``batch_pos`` (both from 0) from a row number that starts at 1."""
    index = F.col(row_no) - 1
    return numbered.withColumns(
        {
            "batch_id": F.floor(index / BATCH_SIZE).cast("long"),
            "batch_pos": (index % BATCH_SIZE).cast("int"),
        }
    )


def prompt_batches(
    numbered: DataFrame, categories: Sequence[str] = CATEGORIES, row_no: str = "row_no"
) -> DataFrame:
    """``(batch_id, n_sections, prompt)``: one prompt per twenty consecutive sections.

    A batch holds twenty short lines at most, so collecting one is bounded.
    """
    line = F.concat(
        (F.col("batch_pos") + 1).cast("string"), F.lit('. Title: "'), F.col("section_title"),
        F.lit('" | Content preview: "'), F.substring("content", 1, PREVIEW_LENGTH), F.lit('..."'),
    )
    lines = with_batch(numbered, row_no).select("batch_id", "batch_pos", line.alias("line"))
    batches = lines.groupBy("batch_id").agg(
        F.count("*").alias("n_sections"),
        F.sort_array(F.collect_list(F.struct("batch_pos", "line"))).alias("lines"),
    )
    # The wording of the request.
    head = (
        "Categorize each of the following website sections into one of these categories:\n\n"
        + "\n".join(f"- {c}" for c in categories)
        + "\n\nSections to categorize:\n"
    )
    tail = (
        "\n\nRespond with a JSON array of category strings in the same order as the input "
        "sections.\nOnly use categories from the list provided. If unsure, use \"Other\".\n"
        'Example response: ["About/Company Overview", "Products/Services", "Contact Information"]'
    )
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    prompt = F.concat(F.lit(head), body, F.lit(tail))
    return batches.select("batch_id", "n_sections", prompt.alias("prompt"))


def reply_labels(reply: Column | str) -> Column:
    """The array of labels in a reply, or null if it is not one JSON array.

    A reply may stand in a code fence. It has to be valid both as the value of an object
    and as the only element of an array: a parser passes over what follows a whole value,
    and no text that goes on after the array fits into both.
    """
    text = strip(reply)
    fenced = F.regexp_replace(F.split_part(text, F.lit("```"), F.lit(2)), "^json", "")
    body = F.when(text.startswith("```"), fenced).otherwise(text)
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    value = F.from_json(
        F.concat(F.lit('{"labels":'), body, F.lit("}")), "labels array<string>", strict
    )["labels"]
    alone = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<array<string>>", strict)
    return F.when((F.size(alone) == 1) & F.get(alone, 0).isNotNull(), value)


def apply_replies(
    numbered: DataFrame,
    replies: DataFrame,
    keywords: Mapping[str, Sequence[str]] = KEYWORDS,
    row_no: str = "row_no",
) -> DataFrame:
    """Sets ``ai_category`` from ``replies(batch_id, reply)``, one reply per batch.

    Labels go by position and are taken as they are; where a reply is too short the
    rest is ``Other``; without a readable reply the whole batch is categorised by
    keyword. Every batch has twenty rows at most, so the join has no hot key.
    """
    parsed = replies.select("batch_id", reply_labels("reply").alias("_labels"))
    joined = with_batch(numbered, row_no).join(parsed, "batch_id", "left")
    labels, pos = F.col("_labels"), F.col("batch_pos")
    label = (
        F.when(labels.isNull(), keyword_category("section_title", keywords))
        .when(pos < F.size(labels), F.coalesce(F.get(labels, pos), F.lit("")))
        .otherwise(OTHER)
    )
    keep = [c for c in numbered.columns if c != "ai_category"]
    return joined.select(*named(keep), label.alias("ai_category"))
