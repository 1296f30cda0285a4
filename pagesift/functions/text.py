"""Text columns: cleaning, phrase removal, counting and entity decoding."""

from __future__ import annotations

from collections.abc import Iterable
from html.entities import html5, name2codepoint
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the code points that str.isspace() accepts, as the body of a
# regex class that Java and RE2 read alike.
SPACE = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Named entities an HTML 4 parser resolves, plus the XML one it lacks.
ENTITIES: dict[str, str] = {n: chr(c) for n, c in name2codepoint.items()} | {"apos": "'"}

# Names that are resolved without a semicolon as well, the longest that fits.
LOOSE_ENTITIES: dict[str, str] = {n: c for n, c in html5.items() if not n.endswith(";")}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, as the only element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim every Unicode space, not only U+0020."""
    return F.btrim(_col(c), F.lit(SPACE_CHARS))


def collapse_space(c: Column | str) -> Column:
    """Every run of whitespace becomes one blank, none is left at the ends.

    The property class tests a character once, where ``SPACE`` tests range by range;
    it lacks only the four separators U+001C to U+001F.
    """
    return F.trim(F.regexp_replace(_col(c), r"(?U)[\s\x{1c}-\x{1f}]+", " "))


def clean_text(c: Column | str) -> Column:
    """Blank out tags and entities, delete http(s) URLs, collapse whitespace; null is ''.

    Tags and both entity forms become one blank each and cannot overlap, so one
    left-to-right pass over the alternation equals three passes in turn. Texts
    without their first characters skip it, and so do texts without an address: what is
    blanked out cannot bring the letters of ``http`` together.
    """
    text = text_or_empty(c)
    blanked = F.regexp_replace(text, r"<[^>]+>|&[a-zA-Z]+;|&#\p{Nd}+;", " ")
    no_markup = F.when(text.contains("<") | text.contains("&"), blanked).otherwise(text)
    no_url = F.regexp_replace(no_markup, f"https?://[^{SPACE}]+", "")
    return collapse_space(F.when(text.contains("http"), no_url).otherwise(no_markup))


def literal_start(pattern: str) -> str:
    """Lower-case text every match of a regex starts with; '' if none can be told."""
    if "|" in pattern:
        return ""
    out, i = "", 0
    while i < len(pattern):
        step = 2 if pattern[i] == "\\" else 1
        char = pattern[i + step - 1 : i + step]
        plain = char.isalnum() or char in " /-_&" if step == 1 else not char.isalnum()
        if not char or not plain or not char.isascii() or pattern[i + step : i + step + 1] in tuple("*?{"):
            break
        out, i = out + char, i + step
    return out.lower()


# Characters that match an ASCII letter when case is ignored, but whose lower case is
# not that letter or not one character: long s, dotless i, dotted I, Kelvin sign.
_ODD_CASE = ("\u017f", "\u0131", "\u0130", "\u212a")


def strip_phrases(
    c: Column | str, phrases: Iterable[str], collapsed: bool = False,
    lowered: Column | None = None,
) -> Column:
    """Delete each pattern in order, ignoring case, then collapse whitespace.

    Few texts hold any phrase. A text that holds the literal start of none of them
    stays as it is, which a plain search tells far sooner than the patterns would.
    ``collapsed`` says that the whitespace of the input is already in order; ``lowered``
    may give the lower-case text where it is a column already.
    """
    text, phrases = _col(c), list(phrases)
    starts = {p: literal_start(p) for p in phrases}
    if not phrases or "" in starts.values():
        out = text
        for phrase in phrases:
            out = F.regexp_replace(out, f"(?iuU){phrase}", "")
        return collapse_space(out)
    some = sorted(set(starts.values()))

    def stripped(t: Column) -> Column:
        if lowered is not None:
            found = contains_any(lowered, some)
        else:
            # An array of one: its only element is computed once for all the searches.
            found = F.exists(F.array(F.lower(t)), lambda low: contains_any(low, some))
        suspect = found | contains_any(t, _ODD_CASE)
        untouched = t if collapsed else collapse_space(t)
        return F.when(suspect, collapse_space(_without_phrases(t, starts))).otherwise(untouched)

    # A text that is no column yet would be computed for each use.
    return stripped(text) if lowered is not None else let(text, stripped)


def _without_phrases(text: Column, starts: dict[str, str]) -> Column:
    """Deletes each phrase, in order, from a text that then holds its literal start.

    What is left of a text is put in lower case again only where a phrase was looked for.
    Deleting makes no odd characters; a text that holds one has every phrase looked for.
    """
    state = F.struct(text.alias("text"), F.lower(text).alias("low"), contains_any(text, _ODD_CASE).alias("odd"))

    def step(phrase: str, start: str):
        def cut(s: Column) -> Column:
            left = F.regexp_replace(s["text"], f"(?iuU){phrase}", "")
            made = let(left, lambda t: F.struct(t.alias("text"), F.lower(t).alias("low"), s["odd"].alias("odd")))
            return F.when(s["odd"] | s["low"].contains(start), made).otherwise(s)

        return cut

    for phrase, start in starts.items():
        state = let(state, step(phrase, start))
    return state["text"]


def word_count(c: Column | str) -> Column:
    """Number of whitespace-separated words; '' and null have none."""
    flat = collapse_space(text_or_empty(c))
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))


def flatten_newlines(c: Column | str, sep: str = " | ") -> Column:
    return strip(F.replace(text_or_empty(c), F.lit("\n"), F.lit(sep)))


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | c.contains(needle)
    return hit


def _looked_up(names: dict[str, str], name: Column, buckets: int = 64) -> Column:
    """What a name stands for, or null: a map is searched from its start, so names are dealt
    into small ones by their checksum."""
    own: list[list[str]] = [[] for _ in range(buckets)]
    for k, v in names.items():
        own[crc32(k.encode()) % buckets].append(f"{k}\t{v}")
    maps = [F.str_to_map(F.lit("\n".join(pairs)), F.lit("\n"), F.lit("\t")) for pairs in own]
    return F.try_element_at(F.get(F.array(*maps), (F.crc32(name) % buckets).cast("int")), name)


def _utf8(code: Column) -> Column:
    """The character of a code point; its bytes are summed up as one number."""
    def six(shift: int) -> Column:
        return F.shiftright(code, shift).bitwiseAND(63)

    two = F.lit(0xC080) + F.shiftright(code, 6) * 256 + six(0)
    three = F.lit(0xE08080) + F.shiftright(code, 12) * 65536 + six(6) * 256 + six(0)
    four = F.lit(0xF0808080) + F.shiftright(code, 18) * 16777216 + six(12) * 65536 + six(6) * 256 + six(0)
    number = F.when(code < 0x80, code).when(code < 0x800, two).when(code < 0x10000, three).otherwise(four)
    return F.unhex(F.hex(number)).cast("string")


def _entity(name: Column) -> Column:
    """The character an entity name stands for, or null."""
    is_hex = name.startswith("#x") | name.startswith("#X")
    # More than seven digits are beyond the last character, whatever they are, but for zeros.
    digits = F.regexp_replace(name, "^#[xX]?0*", "")
    long = F.when(F.length(digits) <= 7, digits).otherwise("9999999")

    def number(skip: int) -> Column:
        return F.when(F.length(name) <= 8, F.substr(name, F.lit(skip))).otherwise(long)

    value = F.when(is_hex, F.conv(number(3), 16, 10)).otherwise(number(2))

    def char(code: Column) -> Column:
        legal = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(legal, _utf8(code)).otherwise("\ufffd")

    return F.when(name.startswith("#"), let(F.coalesce(value.try_cast("long"), F.lit(0)), char)).when(
        name != "", _looked_up(ENTITIES, name)
    )


def decode_entities(c: Column | str, attribute: bool = False) -> Column:
    """Resolve character references once, left to right (``&amp;nbsp;`` gives ``&nbsp;``).

    A number, or the longest of the old names that a reference begins with, counts without
    its semicolon too (``&copy 2024``, ``&ampx``); in an attribute not before a letter,
    a digit or an equals sign, as addresses have them (``?a=1&copy=2``).
    """
    text = _col(c)
    pattern = r"^(#[0-9]+|#[xX][0-9a-fA-F]+);"
    longest = max(map(len, ENTITIES))
    by_letter: dict[str, list[str]] = {}  # fewer ways to try than a list of all names
    for n in sorted(LOOSE_ENTITIES, key=lambda n: (-len(n), n)):
        by_letter.setdefault(n[0], []).append(n[1:])
    names = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by_letter.items()))
    behind = "(?![a-zA-Z0-9=])" if attribute else ""
    loose = f"^(#[0-9]+|#[xX][0-9a-fA-F]+|{names}){behind}"

    def piece(p: Column, i: Column) -> Column:
        def after(n: Column) -> Column:
            return F.substr(p, n + 1)

        def open_ended(name: Column) -> Column:
            char = F.when(name.startswith("#"), _entity(name)).when(
                name != "", _looked_up(LOOSE_ENTITIES, name)
            )
            size = F.length(name)
            size = F.when(F.substr(p, size + 1, F.lit(1)) == ";", size + 1).otherwise(size)
            return F.coalesce(F.concat(char, after(size)), F.concat(F.lit("&"), p))

        def closed(n: Column) -> Column:
            # A name needs no pattern: what stands before the semicolon is one or is not.
            name = F.when(p.startswith("#"), F.regexp_extract(p, pattern, 1))
            name = name.when((n > 0) & (n <= longest), F.substr(p, F.lit(1), n)).otherwise("")
            return F.concat(let(name, _entity), after(n + 1))

        # No name or number begins with what sorts before or behind these.
        may = (p >= "#") & (p < "{")
        solved = F.coalesce(let(F.instr(p, F.lit(";")) - 1, closed), let(F.regexp_extract(p, loose, 1), open_ended))
        return F.when(i == 0, p).when(may, solved).otherwise(F.concat(F.lit("&"), p))

    decoded = F.array_join(F.transform(F.split(text, "&"), piece), "")
    return F.when(text.contains("&"), decoded).otherwise(text)
