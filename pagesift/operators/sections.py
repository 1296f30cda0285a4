"""Pages to sections: headings, and the text that belongs to each.

A page is split into tags and texts, one row each. Running windows over a page
say how deep in containers every row is and which heading of each level covers
it: the last heading of that level or a higher one, if it is of that level. At
most six headings, one per level, cover a text, so the rows of a heading come from
an ``explode`` of at most six, not from a join of headings with texts.

Pages are stripped to their block tags and texts first and hashed by ``page_id`` as
one row each; every window, aggregate and sort after that has ``page_id`` among its
keys and runs without another shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift.functions import html as H
from pagesift.functions.text import (
    SPACE_CHARS, collapse_space, decode_entities, let, strip, text_or_empty,
)
from pagesift.operators.elements import CONTAINERS, element_steps
from pagesift.operators.filters import freeze

# Rows a page without sections stands for, and the length limit.
ERROR_ROW = ("ERROR", "error", "Failed to fetch page")
EMPTY_ROW = ("NO_CONTENT", "none", "No sections found on page")
MAIN_ROW = ("Main Content", "body")
MAX_CONTENT = 5000

# Containers that end a heading when they begin.
CELLS = ("li", "dt", "dd", "tr", "td", "th")
# The others that start a block are often left open; they tell one sibling from the next.
LEAVES = ("p", "caption", "pre", "address", "hr", "figcaption", "summary", "option")
# Inline elements without content.
VOID = (
    "area", "base", "br", "col", "embed", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

# Where the text of a section was found.
SIBLINGS, PARENT, GRANDPARENT, ORDER = (
    "siblings", "parent_siblings", "grandparent_siblings", "document_order"
)

# The ancestors that may hold a section, and how many are looked at.
HOLDER_TAGS = ("section", "article", "div")
HOLDER_CLASSES = ("section", "content", "block", "card", "panel", "box", "module")
HOLDER_REACH = 5

_PAGE = 0  # heading position that stands for the page itself
_ITSELF = 1 << 32  # the same, packed: position 0, depth 0, level 0
_BLOCKS = tuple(f"{s}{t}" for t in (*CONTAINERS, *LEAVES, *HEADINGS, "title") for s in ("", "/"))
_ENDS_HEADING = tuple(f"/{t}" for t in (*CONTAINERS, *HEADINGS)) + CELLS + LEAVES
_INLINE_OPEN, _INLINE_CLOSE, _INLINE_VOID = "+", "-", "0"


def _tag(token: Column) -> Column:
    """Name of a block tag, with the slash of a closing one; a sign for an inline tag."""

    def kind(name: Column) -> Column:
        void = name.isin(*VOID) | token.endswith("/>")
        inline = F.when(name.startswith("/"), _INLINE_CLOSE).when(void, _INLINE_VOID)
        return F.when((name == "") | name.isin(*_BLOCKS), name).otherwise(
            F.coalesce(inline, F.lit(_INLINE_OPEN))
        )

    name = F.regexp_extract(token, "^<(/?[a-zA-Z][a-zA-Z0-9:_-]*)", 1)
    return let(F.lower(name), kind)


def _is_holder(token: Column) -> Column:
    tag = "|".join(HOLDER_TAGS)
    classes = F.lower(H.attribute(token, "class"))
    words = "|".join(HOLDER_CLASSES)
    return token.rlike(rf"(?i)^<(?:{tag})(?![a-zA-Z0-9])") & classes.rlike(words)


META = ("page_title", "description", "canonical_url")


def page_markup(pages: DataFrame, meta: Sequence[str] = META) -> DataFrame:
    """Pages without comments, scripts and styles, with the metadata in ``meta``.

    ``page_id, url, *meta, has_html, markup``. Each step is frozen, so that no tag is
    looked for twice; what ``meta`` leaves out is not looked for at all.
    """
    source = pages.select("page_id", "url", text_or_empty("html").alias("html"))
    markup = freeze(
        source.withColumn("has_html", F.col("html") != ""),
        markup=H.strip_elements("html", "script|style"),
    ).drop("html")
    tags = F.col("_tags")
    source = {}
    if "page_title" in meta:
        source["_title"] = H.title_source("markup")
    if "description" in meta or "canonical_url" in meta:
        source["_tags"] = H.head_tags("markup")
    chosen = {}
    if "description" in meta:
        chosen["_plain"] = H.first_meta(tags, "name", "description")
        chosen["_social"] = H.first_meta(tags, "property", "og:description")
    if "canonical_url" in meta:
        chosen["_link"] = H.first_canonical(tags)
    found = freeze(markup, **source) if source else markup
    found = freeze(found, **chosen) if chosen else found
    values = {
        "page_title": lambda: H.page_title(F.col("_title")),
        "description": lambda: H.meta_description(F.col("_plain"), F.col("_social")),
        "canonical_url": lambda: H.canonical_url(F.col("_link"), F.col("url")),
    }
    return found.select(
        "page_id", "url", *[values[c]().alias(c) for c in meta], "has_html", "markup"
    )


def page_meta(pages: DataFrame, meta: Sequence[str] = META) -> DataFrame:
    """``page_id, url`` and the metadata in ``meta``."""
    return page_markup(pages, meta).drop("has_html", "markup")


PARSED = ("page_id", "url", "page", "pieces", "steps")


def parse_pages(pages: DataFrame, holders: bool = True) -> DataFrame:
    """Pages as their pieces: ``page_id, url, page, pieces, steps``, one row each.

    ``page`` holds url, metadata, and whether there is html; a piece is a tag or a non-blank
    text; ``steps`` are the containers that each of them closes and opens. With
    ``holders``, opening tags that look like section containers are marked. A page
    without an id has no row: nothing could be told to be of it.
    """

    def piece(t: Column) -> Column:
        none = F.lit(False)
        tag = F.struct(
            _tag(t).alias("tag"), F.lit("").alias("text"),
            (_is_holder(t) if holders else none).alias("holder"),
        )
        text = F.struct(
            F.lit("").alias("tag"), strip(decode_entities(t)).alias("text"), none.alias("holder")
        )
        return F.when(H.is_tag(t), tag).otherwise(text)

    content = F.when(
        F.col("markup").rlike("(?i)<noscript"), H.strip_elements("markup", "noscript")
    ).otherwise(F.col("markup"))
    narrow = freeze(
        page_markup(pages),
        page=F.struct("url", "page_title", "description", "canonical_url", "has_html"),
        pieces=F.filter(
            F.transform(H.tokens(content), piece), lambda x: (x["tag"] != "") | (x["text"] != "")
        ),
    ).select("page_id", "url", "page", "pieces").where(F.col("page_id").isNotNull())
    return narrow.withColumn("steps", element_steps(F.transform("pieces", lambda x: x["tag"])))


def page_pieces(pages: DataFrame, holders: bool = False) -> DataFrame:
    """One row per tag and non-blank text of a page, in document order.

    ``pos`` counts from 1; ``tag`` is '' for a text and a sign for an inline tag; ``closes``
    and ``opens`` are the containers that a tag closes and opens. Every page has a row, also
    one without html; its first row carries ``page``. With ``holders``, ``holder`` marks
    opening tags that look like section containers.

    The pages are hashed by ``page_id`` when all that is left of them are the pieces. Where
    ``pages`` are parsed already (``stored_pages``), they lie as they are to lie.
    """
    if set(PARSED) <= set(pages.columns):
        placed = pages
    else:
        placed = parse_pages(pages, holders).repartition("page_id")
    rows = placed.select(
        "page_id", "page",
        F.posexplode_outer(F.arrays_zip("pieces", "steps")).alias("_i", "both"),
    ).select("page_id", "page", "_i", "both.pieces", "both.steps").toDF(
        "page_id", "page", "_i", "piece", "step"
    )
    step = F.coalesce("step", F.lit(0))
    index = F.coalesce("_i", F.lit(0))
    return rows.select(
        "page_id",
        (index + 1).alias("pos"),
        F.coalesce("piece.tag", F.lit("")).alias("tag"),
        F.coalesce("piece.text", F.lit("")).alias("text"),
        F.when(index == 0, F.col("page")).alias("page"),
        F.shiftright(step, 1).alias("closes"),
        step.bitwiseAND(F.lit(1)).alias("opens"),
        *([F.coalesce("piece.holder", F.lit(False)).alias("holder")] if holders else []),
    )


# A page has less than 2^31 bytes: less than 2^30 pieces, and tags for less than 2^29
# levels up or down. Position, depth and level of a heading fit 63 bits.
_FLAT = 1 << 29


def _pack(pos: Column, depth: Column, level: Column) -> Column:
    return F.shiftleft(pos.cast("long"), 33) + F.shiftleft((depth + _FLAT).cast("long"), 3) + level


def _pos(packed: Column) -> Column:
    return F.shiftright(packed, 33).cast("int")


def _depth(packed: Column) -> Column:
    return (F.shiftright(packed, 3).bitwiseAND(F.lit((1 << 30) - 1)) - _FLAT).cast("int")


def _level(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(7)).cast("int")


def _located(pieces: DataFrame) -> DataFrame:
    """Adds to every row its depth, its headings, and what surrounds it.

    Two pages of one id would become one, so that fails.
    ``cover`` has the last heading of level <= L at L - 1, packed into a number that
    grows with its position, so that the last one is the running maximum.
    ``in_heading`` is the position of the heading the row lies in, or null.
    ``low`` is the depth at which a tag separates siblings, null for other rows: the
    smallest depth a block tag touches, and the depth of an inline element that lies
    directly in a container. Inline elements are counted from the last block tag on.
    """
    tag = F.col("tag")
    page = W.partitionBy("page_id").orderBy("pos")
    upto = page.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = page.rowsBetween(W.unboundedPreceding, -1)
    whole = page.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    def balance(name: str) -> Column:
        return F.when(tag == name, 1).when(tag == f"/{name}", -1).otherwise(0)

    def n(test: Column, frame=upto) -> Column:
        return F.count(F.when(test, 1)).over(frame)

    turned = pieces.withColumn("_turn", F.col("opens") - F.col("closes"))
    inline = F.when(tag == _INLINE_OPEN, 1).when(tag == _INLINE_CLOSE, -1).otherwise(0)
    stray = tag.isin(*[f"/{t}" for t in CONTAINERS]) & (F.col("closes") == 0)
    is_block = ~tag.isin("", _INLINE_OPEN, _INLINE_CLOSE, _INLINE_VOID) & ~stray
    twice = n(F.col("page").isNotNull(), whole) > 1
    depth = F.when(
        twice, F.raise_error(F.concat(F.lit("page_id is not unique: "), F.col("page_id").cast("string")))
    ).otherwise(F.sum("_turn").over(upto))
    deep = turned.withColumns(
        {
            "depth": depth.cast("int"),
            "_article": F.sum(balance("article")).over(upto),
            "_inline": F.sum(inline).over(upto),
        }
    )
    # An open leaf or heading is the sibling; what is inline in it separates nothing.
    is_leaf = tag.isin(*LEAVES, *HEADINGS)
    block = F.when(is_block, F.struct(F.col("_inline").alias("inline"), is_leaf.alias("leaf")))
    level = F.when(tag.isin(*HEADINGS), F.substring(tag, 2, 1).cast("int"))
    heading = _pack(F.col("pos"), F.col("depth"), level)
    covers = [F.max(F.when(level <= top, heading)).over(upto) for top in range(1, 7)]
    marked = deep.withColumns(
        {
            "gap": n(F.col("text") != "", before),
            "cover": F.array(*covers),
            "_block": F.last(block, ignorenulls=True).over(upto),
            "_ended": F.max(F.when(tag.isin(*_ENDS_HEADING) & ~stray, F.col("pos"))).over(upto),
            "_in_main": (n(tag == "main") > 0) & (n(tag == "/main") == 0),
            "_in_article": (n(tag == "article") > 0)
            & (n((tag == "/article") & (F.col("_article") <= 0)) == 0),
            "_in_title": (n(tag == "title") == 1) & (n(tag == "/title") == 0),
            "_has_main": n(tag == "main", whole) > 0,
            "_has_article": n(tag == "article", whole) > 0,
        }
    )
    nested = F.col("_inline") - F.coalesce(F.col("_block.inline"), F.lit(0))
    at_top = (
        ((tag == _INLINE_OPEN) & (nested == 1))
        | ((tag == _INLINE_CLOSE) & (nested <= 0))
        | ((tag == _INLINE_VOID) & (nested <= 0))
    ) & ~F.coalesce(F.col("_block.leaf"), F.lit(False))
    low = F.when(is_block, F.col("depth") - F.col("opens")).when(at_top, F.col("depth"))
    last = _pos(F.col("cover")[5])
    in_main_text = (
        F.when(F.col("_has_main"), F.col("_in_main"))
        .when(F.col("_has_article"), F.col("_in_article"))
        .otherwise(~F.col("_in_title"))
    )
    return marked.select(
        *pieces.columns, "depth", "gap", "cover", low.alias("low"),
        F.when(last > F.coalesce("_ended", F.lit(0)), last).alias("in_heading"),
        in_main_text.alias("in_main"),
    )


def page_headings(pages: DataFrame) -> DataFrame:
    """Headings in document order: ``page_id, head_no, section_level, depth, title, next_no``.

    Headings with an empty title are listed, as they end the sections before them.
    ``next_no`` is the next heading of the same or a higher level, or null.
    """
    inside = _located(page_pieces(pages)).where(F.col("in_heading").isNotNull())
    is_open = F.col("pos") == F.col("in_heading")
    titled = inside.groupBy("page_id", "in_heading").agg(
        F.max(F.when(is_open, F.col("tag"))).alias("section_level"),
        F.max(F.when(is_open, F.col("depth"))).alias("depth"),
        _joined(F.col("text") != "", "pos").alias("title"),
    )
    page = W.partitionBy("page_id").orderBy("in_heading")
    numbered = titled.withColumn("head_no", F.row_number().over(page))
    after = page.rowsBetween(1, W.unboundedFollowing)
    level = F.col("section_level")
    following = F.coalesce(
        *[
            F.when(
                level == own, F.min(F.when(level <= own, F.col("head_no"))).over(after)
            )
            for own in HEADINGS
        ]
    )
    return numbered.select(
        "page_id", "head_no", "section_level", "depth", "title", following.alias("next_no")
    )


def _joined(test: Column, order: str, sep: str = "") -> Column:
    """Texts of a group's rows that pass ``test``, in order, as one string."""
    found = F.sort_array(F.collect_list(F.when(test, F.struct(order, "text"))))
    return F.array_join(F.transform(found, lambda x: x["text"]), sep)


def _covered(pages: DataFrame) -> DataFrame:
    """One row per text and heading that covers it, with how far it lies from the heading.

    ``reach`` is 0 under the heading's own parent, 1 under its grandparent and so
    on, and -1 for the title itself. The page is a heading of its own at position 0,
    with the text of its main element if no heading has a title.
    """
    last_row = F.struct("text", "cover", "in_heading", "in_main")
    texts = (
        _located(page_pieces(pages))
        .groupBy("page_id", "gap")
        .agg(
            F.min("low").alias("low"),
            F.max_by(last_row, "pos").alias("row"),
            F.first("page", ignorenulls=True).alias("page"),
        )
        .select("page_id", "gap", "low", "page", "row.*")
    )
    whole = W.partitionBy("page_id").orderBy("gap").rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing
    )
    has_text = F.col("text") != ""
    titled = F.max(has_text & F.col("in_heading").isNotNull()).over(whole)
    flagged = texts.withColumn("_is_main", has_text & ~titled & F.col("in_main"))
    cover = F.filter(
        F.col("cover"), lambda h, i: h.isNotNull() & (_level(h) == i + 1) & has_text
    )
    itself = F.array(F.lit(_ITSELF))
    heads = F.when(
        F.col("page").isNotNull() | F.col("_is_main"), F.concat(cover, itself)
    ).otherwise(cover)
    head = F.col("head")
    pairs = flagged.withColumn("head", F.explode(heads)).select(
        "page_id", "gap", "low", "page", _pos(head).alias("head_pos"),
        _level(head).alias("level"), _depth(head).alias("head_depth"),
        F.when((head != _ITSELF) | F.col("_is_main"), F.col("text")).otherwise("").alias("text"),
        F.coalesce(F.col("in_heading") == _pos(head), F.lit(False)).alias("own"),
    )
    group = W.partitionBy("page_id", "head_pos").orderBy("gap")
    upto = group.rowsBetween(W.unboundedPreceding, W.currentRow)
    since = F.min(F.when(~F.col("own"), F.col("low"))).over(upto)
    distance = F.greatest(F.lit(0), F.col("head_depth") - since)
    reached = pairs.withColumn(
        "reach",
        F.when(F.col("own"), -1).when(F.col("head_pos") == _PAGE, 0).otherwise(distance),
    )
    all_rows = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nearest = F.min(F.when(F.col("reach") >= 0, F.col("reach"))).over(all_rows)
    return reached.withColumn("path", nearest)


def extract_sections(pages: DataFrame, max_content: int | None = MAX_CONTENT) -> DataFrame:
    """``pages(page_id, url, html)`` to sections, numbered by ``sec_no`` within a page.

    The content of a heading is the text up to the next heading of the same or a
    higher level: that under its own parent; if there is none, that under its
    grandparent, then its great-grandparent; else all of it in document order, each
    piece once. ``content_source`` says which. Pieces of one sibling element are
    joined by a bar, siblings by a blank. A page without headings gives its main
    text, one without text or html a row that says so.
    """
    path = F.col("path")
    near = path <= 2
    used = F.col("own") | (F.col("reach") == path) | F.coalesce(~near, F.lit(True))
    sibling = F.when(F.col("low") <= F.col("head_depth") - path, " ").otherwise(" | ")
    piece = F.struct("gap", "own", sibling.alias("sep"), "text")
    kept = used & (F.col("text") != "")
    grouped = _covered(pages).groupBy("page_id", "head_pos").agg(
        F.max("level").alias("level"),
        F.max("path").alias("path"),
        F.first("page", ignorenulls=True).alias("page"),
        F.sort_array(F.collect_list(F.when(kept, piece))).alias("pieces"),
    )
    pieces = F.col("pieces")
    text_of = lambda x: x["text"]
    title = F.array_join(F.transform(F.filter(pieces, lambda x: x["own"]), text_of), "")
    body = F.filter(pieces, lambda x: ~x["own"])
    joined = F.array_join(F.transform(body, lambda x: F.concat(x["sep"], x["text"])), "")
    in_order = F.array_join(F.array_distinct(F.transform(pieces, text_of)), " ")
    content = (
        F.when(F.col("head_pos") == _PAGE, F.array_join(F.transform(pieces, text_of), " "))
        .when(near, collapse_space(joined))
        .otherwise(collapse_space(in_order))
    )
    if max_content is not None:
        content = F.substring(content, 1, max_content)
    made = freeze(grouped, title=title, content=content)
    page = W.partitionBy("page_id").orderBy("head_pos")
    whole = page.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    upto = page.rowsBetween(W.unboundedPreceding, W.currentRow)
    named = F.count(F.when(F.col("title") != "", 1))
    numbered = made.withColumns(
        {
            "_n": named.over(whole),
            "sec_no": F.greatest(named.over(upto), F.lit(1)).cast("int"),
            "page": F.first("page", ignorenulls=True).over(whole),
        }
    ).where((F.col("title") != "") | ((F.col("head_pos") == _PAGE) & (F.col("_n") == 0)))
    is_page = F.col("head_pos") == _PAGE
    failed = is_page & (F.col("content") == "")
    no_html = ~F.col("page.has_html")

    def shown(i: int, heading: Column, main: Column) -> Column:
        stand_in = F.when(no_html, ERROR_ROW[i]).otherwise(EMPTY_ROW[i])
        return F.when(failed, stand_in).when(is_page, main).otherwise(heading)

    level = F.concat(F.lit("h"), F.col("level").cast("string"))
    source = (
        F.when(failed, "none").when(is_page, "main").when(path == 0, SIBLINGS)
        .when(path == 1, PARENT).when(path == 2, GRANDPARENT).otherwise(ORDER)
    )
    return numbered.select(
        "page_id", F.col("page.url").alias("url"), "sec_no",
        *[
            F.when(failed, "").otherwise(F.col(f"page.{c}")).alias(c)
            for c in ("page_title", "description", "canonical_url")
        ],
        shown(0, F.col("title"), F.lit(MAIN_ROW[0])).alias("section_title"),
        shown(1, level, F.lit(MAIN_ROW[1])).alias("section_level"),
        shown(2, F.col("content"), F.col("content")).alias("content"),
        source.alias("content_source"),
    )


def container_sections(pages: DataFrame, max_content: int | None = MAX_CONTENT) -> DataFrame:
    """Content taken from the container around a heading: an alternative, not the default.

    The container is the nearest of the five innermost ones that is a ``section``,
    ``article`` or ``div`` with a telling class; its text loses a leading title.
    Headings without such a container give no row.

    Only headings are told their containers, five at most: the last tag that opened
    depth d before a heading opened the container it lies in at that depth, and the next
    one that closes d closes it. A page's texts are joined once; a container's text is a
    piece of that, cut to what the title and the limit need.
    """
    rows = _located(page_pieces(pages, holders=True))
    has_text = F.col("text") != ""
    in_title = F.col("in_heading").isNotNull()
    page = W.partitionBy("page_id").orderBy("pos")
    title = F.array_join(
        # Rows outside of headings share a window, too; nothing is collected in it.
        F.collect_list(F.when(in_title & has_text, F.col("text"))).over(
            W.partitionBy("page_id", "in_heading").orderBy("pos").rowsBetween(
                W.unboundedPreceding, W.unboundedFollowing
            )
        ),
        "",
    )
    # Where a row's text begins in the joined texts, from 0.
    written = F.sum(F.when(has_text, F.length("text") + 1).otherwise(0))
    placed = rows.withColumns(
        {
            "title": F.when(in_title, title),
            "off": F.coalesce(written.over(page.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    texts = placed.where(has_text).groupBy("page_id").agg(_joined(has_text, "pos", " ").alias("whole"))
    is_head = F.col("tag").isin(*HEADINGS) & (F.col("title") != "")
    opens, closes, depth = F.col("opens") == 1, F.col("closes"), F.col("depth")
    near = F.sequence(depth, F.greatest(depth - (HOLDER_REACH - 1), F.lit(1)), F.lit(-1))
    # The depths that a tag closes, from the outermost; it opens the same one, if any.
    outer = F.when(opens, depth).otherwise(depth + 1)
    closed = F.sequence(outer, outer + closes - 1)
    marks = placed.where(opens | (closes > 0) | (is_head & (depth > 0))).select(
        "page_id", "pos", "off", "title", "holder", "depth", "opens", "closes",
        is_head.alias("is_head"),
        F.explode(
            F.when(closes > 0, closed).when(opens, F.array(depth)).otherwise(near)
        ).alias("at"),
    )
    level = W.partitionBy("page_id", "at")
    before = level.orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    after = level.orderBy(F.col("pos").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    opener = F.when(opens & (F.col("at") == depth), F.struct("off", "holder"))
    held = marks.withColumns(
        {
            "opener": F.last(opener, ignorenulls=True).over(before),
            "end": F.last(F.when(closes > 0, F.col("off")), ignorenulls=True).over(after),
        }
    ).where(F.col("is_head") & F.col("opener.holder"))
    chosen = held.groupBy("page_id", "pos").agg(
        F.max_by(F.struct("title", F.col("opener.off").alias("start"), "end"), "at").alias("box")
    )
    heads = chosen.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "box"))).alias("heads")
    )

    def content(box: Column) -> Column:
        """Cut before the headings become rows, so that none carries the whole page."""
        end = F.coalesce(box["end"], F.length("whole") + 1)  # a container may stay open
        size = end - box["start"] - 1
        title_size = F.length(box["title"])
        # Twice the limit, as blanks after the title do not count.
        wanted = size if max_content is None else F.least(size, title_size + 2 * max_content + 1)

        def without_title(text: Column) -> Column:
            rest = F.ltrim(F.substr(text, title_size + 1, F.length(text)), F.lit(SPACE_CHARS))
            own = F.when(F.startswith(text, box["title"]), rest).otherwise(text)
            return own if max_content is None else F.substring(own, 1, max_content)

        return let(F.substr("whole", box["start"] + 1, wanted), without_title)

    found = heads.join(texts, "page_id").select(
        "page_id",
        F.posexplode(
            F.transform(
                "heads",
                lambda h: F.struct(
                    h["box"]["title"].alias("section_title"), content(h["box"]).alias("content")
                ),
            )
        ).alias("i", "section"),
    )
    return found.select("page_id", (F.col("i") + 1).alias("box_no"), "section.*")
