"""HTML columns: page metadata, stripping, and splitting into tags and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.text import _col, decode_entities, let, strip

# What a removed element leaves behind: a tag without a name, so that the texts
# before and after it stay two pieces, as they do in a document tree.
GAP = "<!>"

# Possessive throughout: the matcher loops instead of recursing on long input.
# A quote opens a value only after an equals sign; there it may hide a bracket.
# A bracket that starts no tag is text.
_INSIDE = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
TOKEN = rf"<(?=[a-zA-Z/!?]){_INSIDE}>?|(?:[^<]++|<(?![a-zA-Z/!?]))++"


def strip_elements(html: Column | str, names: str = "script|style|noscript") -> Column:
    """Remove comments and the named elements with all they hold.

    All alternatives start behind one bracket, so that text is passed over quickly.
    """
    parts = [r"!--.*?(?:-->|\z)"] + [
        rf"{n}\b{_INSIDE}>.*?(?:</{n}\s*>|\z)" for n in names.split("|")
    ]
    return F.regexp_replace(_col(html), f"(?is)<(?:{'|'.join(parts)})", GAP)


def tokens(markup: Column | str) -> Column:
    """Array of tags and of the texts between them, in document order."""
    return F.regexp_extract_all(_col(markup), F.lit(TOKEN), F.lit(0))


def is_tag(token: Column) -> Column:
    return token.startswith("<") & token.rlike("^<[a-zA-Z/!?]")


# One attribute after another from the start of a tag, so that nothing inside a quoted
# value is taken for an attribute.
_VALUE = r"""(?:\s*+=\s*+(?:"[^"]*+"?|'[^']*+'?|[^\s>"'][^\s>]*+)?+)?+"""


def _up_to(name: str) -> str:
    """A tag from its start to the first attribute of a name, without the value."""
    other = rf"[\s/]++(?!{name}[\s=/>]|{name}\z)[^\s=/>]++{_VALUE}"
    return rf"(?i)^<[a-zA-Z][^\s/>]*+(?:{other})*+[\s/]++{name}(?=[\s=/>]|\z)"


def has_attribute(tag: Column, name: str) -> Column:
    return tag.rlike(rf"{_up_to(name)}\s*+=")


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of an attribute; '' if it is empty or missing, null for no tag.

    Of attributes with one name the first counts.
    """
    pattern = rf"""{_up_to(name)}\s*+=\s*+("[^"]*+|'[^']*+|[^\s>"'][^\s>]*+)"""
    value = F.regexp_extract(tag, pattern, 1)
    return let(
        F.regexp_replace(value, "^[\"']", ""), lambda v: decode_entities(v, attribute=True)
    )


def head_tags(markup: Column | str) -> Column:
    """Array of all ``meta`` and ``link`` tags."""
    pattern = rf"(?i)<(?:meta|link)(?![a-zA-Z0-9]){_INSIDE}>"
    return F.regexp_extract_all(_col(markup), F.lit(pattern), F.lit(0))


def title_source(markup: Column | str) -> Column:
    """What stands between the first ``title`` tag and the next tag, as written."""
    pattern = rf"(?i)<title(?![a-zA-Z0-9]){_INSIDE}>([^<]*+(?:<(?![a-zA-Z/!?])[^<]*+)*+)"
    return F.regexp_extract(_col(markup), pattern, 1)


def page_title(source: Column) -> Column:
    """Title text, trimmed, from ``title_source``; '' if there is none."""
    return strip(decode_entities(source))


def first_meta(tags: Column, key: str, value: str) -> Column:
    """First ``meta`` tag whose attribute ``key`` is ``value``, or null."""
    return F.get(
        F.filter(tags, lambda t: t.rlike("(?i)^<meta") & (attribute(t, key) == value)), F.lit(0)
    )


def first_canonical(tags: Column) -> Column:
    """First ``link`` tag with ``canonical`` among its relations, or null."""

    def fits(t: Column) -> Column:
        relations = F.split(attribute(t, "rel"), r"\s+")
        return t.rlike("(?i)^<link") & F.array_contains(relations, "canonical")

    return F.get(F.filter(tags, fits), F.lit(0))


def meta_description(plain: Column, social: Column) -> Column:
    """Content of the ``description`` tag, or where it is empty of the ``og:description`` one."""
    return let(
        F.coalesce(attribute(plain, "content"), F.lit("")),
        lambda own: F.when(own != "", own).otherwise(
            F.coalesce(attribute(social, "content"), F.lit(""))
        ),
    )


def canonical_url(link: Column, url: Column) -> Column:
    """Target of the canonical link, else the page's own address."""
    return F.when(has_attribute(link, "href"), attribute(link, "href")).otherwise(url)
