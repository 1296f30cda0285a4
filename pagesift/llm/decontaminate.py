"""Benchmark passages in documents, found by templates.

Texts are cut into tokens. A token's canonical form is its lower-case word, or a typed
placeholder: a number, a unit after a number, or a name (a capitalised word inside a
sentence). Every ``WINDOW`` canonical tokens of a benchmark item are a template window, and every ``WINDOW``
lower-case words and numbers a plain one, which capitals cannot change; the windows of
documents are joined with them by hash. Stretches of windows that lie in a document
in the item's own order, at most ``GAP`` tokens apart, are one chain, so single words put in,
left out or replaced do not split a copy; it counts as one if it covers ``COVERAGE`` of the
item's tokens or ``RUN`` consecutive words. A copy's slots, the
placeholders, are then filled in with what stands there in item and document: a slot value
of the item must have one value throughout the copy. A consistent copy is ``exact`` if all
slots are equal, else ``reparameterised``. An inconsistent one is ``edited`` if ``SAME`` of its
slots equal the item's own; others share a form only and are kept out unless ``RUN`` words
without a slot agree (``partial``).

A copy with other values in its slots says something only where enough of it are words: rows
of numbers of the same length are no copies of each other.

Defined results: null and empty texts have no copies; an item shorter than a window is found
as a whole and with its own values only, as so few forms say nothing, and one of fewer than
``LEAST`` tokens only where it is the whole text; items equal in id and text count once; repeated document
rows give the same rows once per row; a null id is an id of its own. Only the named columns
are read, so other columns cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.columns import named
from pagesift.llm.line_dedup import fresh, once
from pagesift.sources.staging import stage

WINDOW = 5
COVERAGE = 0.8
RUN = 13
#: Share of a copy's slots equal to the item's from which single other values are edits.
SAME = 0.9
#: Tokens from which an item is looked for inside of texts; shorter ones are whole texts.
LEAST = 3
#: Share of a reparameterised copy's tokens that are words and no placeholders.
SAID = 0.25
#: Tokens that two stretches of one copy may stand apart, in item or document.
GAP = 2 * WINDOW
#: Template windows broadcast at a time; a larger benchmark is gone through in blocks.
BROADCAST_WINDOWS = 1_000_000

UNITS = (
    "mm cm m km inch inches ft feet foot mile miles mg g kg lb lbs oz ton tons ml l liter liters "
    "litre litres s sec second seconds min minute minutes h hour hours day days week weeks month "
    "months year years percent degrees usd eur dollars dollar euros euro cents cent mph kmh watts "
    "volts gb mb kb"
).split()

NUMBER, UNIT, NAME = "\uE000", "\uE001", "\uE002"
PLACEHOLDERS = {NUMBER: "number", UNIT: "unit", NAME: "name"}

_WORD = r"\p{L}[\p{L}\p{M}]*"
_DIGITS = r"[0-9]+(?:[.,][0-9]+)*"
_BETWEEN = rf"[^\p{{L}}\p{{M}}{NUMBER}{UNIT}{NAME}]+"
INSIDE = "\uE003"  # a point or comma inside a number
_INSIDE = r"(?<=[0-9])[.,](?=[0-9])"
_NO_TOKEN = rf"[^\p{{L}}\p{{M}}0-9{INSIDE}]+"
#: White space that is no single blank.
_WIDE = r"[\s\x85\p{Z}]{2,}|[\t-\r\x85\p{Z}&&[^ ]]"
_CAPITALISED = r"(?<=[\p{Ll},;] )\p{Lu}\p{Ll}[\p{L}\p{M}]*"
_UNIT_AFTER = rf"(?i)({NUMBER} )\s*(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{M}}])"


def forms(text: Column) -> Column:
    """Canonical tokens of a text: words in lower case, and placeholders."""
    text = F.regexp_replace(text, _WIDE, " ")
    numbers = F.regexp_replace(text, _DIGITS, f" {NUMBER} ")
    units = F.regexp_replace(numbers, _UNIT_AFTER, f"$1 {UNIT} ")
    named_ = F.regexp_replace(F.when(text.rlike("[0-9]"), units).otherwise(text), _CAPITALISED, NAME)
    return F.array_remove(F.split(F.lower(named_), _BETWEEN), "")


def raw_tokens(text: Column) -> Column:
    """The tokens as they stand, one for each canonical one."""
    return F.regexp_extract_all(text, F.lit(f"({_WORD}|{_DIGITS})"), F.lit(1))


def plain_tokens(text: Column) -> Column:
    """The tokens in lower case, one for each canonical one, without placeholders."""
    apart = F.regexp_replace(F.regexp_replace(text, _DIGITS, " $0 "), _INSIDE, INSIDE)
    return F.array_remove(
        F.split(F.lower(F.when(text.rlike("[0-9]"), apart).otherwise(text)), _NO_TOKEN), ""
    )


def _window_hashes(tokens: Column, n: int) -> Column:
    def of(hashes: Column) -> Column:
        last = F.size(hashes) - n
        places = F.when(last >= 0, F.sequence(F.lit(0), last))
        return F.coalesce(
            F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)])),
            F.array(),
        )

    return once(F.transform(tokens, lambda w: F.xxhash64(w)), of)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(key, item, forms, plain, raws) of the items that have a token."""
    item, text = named([item_col, text_col])
    cut = benchmark.where(text.isNotNull()).select(
        F.xxhash64(item, text).alias("key"), item.alias("item"), forms(text).alias("forms"),
        plain_tokens(text).alias("plain"), raw_tokens(text).alias("raws"),
    )
    return cut.where(F.size("forms") > 0).dropDuplicates(["key"])


def _is_slot(form: Column) -> Column:
    return form.isin(*PLACEHOLDERS)


def row_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _entries(tokens: Column, plain: Column, n: int, short: list[int]) -> Column:
    """(at, hash) of template windows, of plain ones that differ, and of ``short`` plain tokens."""

    def placed(hashes):
        return F.transform(hashes, lambda h, i: F.struct(i.alias("at"), h.alias("hash")))

    def both(x):
        other = F.filter(
            placed(x["plain"]), lambda w: ~w["hash"].eqNullSafe(F.get(x["template"], w["at"]))
        )
        return F.concat(placed(x["template"]), other)

    template, same = _window_hashes(tokens, n), _window_hashes(plain, n)
    windows = once(F.struct(template.alias("template"), same.alias("plain")), both)
    def short_ones(k):
        found = placed(_window_hashes(plain, k))
        alone = F.slice(found, F.lit(1), F.when(F.size(plain) == k, 1).otherwise(0))
        return found if k >= LEAST else alone

    return F.concat(windows, *[short_ones(k) for k in short])


def find_copies(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
    coverage: float = COVERAGE, run: int = RUN, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """(id, row, item, start, end, coverage, slots, kind): copies of items in documents.

    ``row`` is ``row_hash`` of the text, which tells rows of one id apart. ``start`` and ``end`` are places among the words and numbers of the document. The
    template windows are counted first; blocks of at most ``broadcast_windows`` of them are
    broadcast in turn, so documents are never shuffled before a window has met.
    """
    items = stage(_items(benchmark, item_col, item_text_col), "benchmark-items")
    size = F.size("forms")
    sizes = items.where(size < window).select(size.alias("size")).distinct().collect()
    short = sorted(r["size"] for r in sizes)
    whole = [
        items.where(size >= window).select(
            "key", "forms", F.explode(_entries(F.col("forms"), F.col("plain"), window, []))
            .alias("w")
        )
    ]
    for k in short:
        entry = F.get(_entries(F.col("forms"), F.col("plain"), window, [k]), 0)
        whole.append(items.where(size == k).select("key", "forms", entry.alias("w")))
    windows = reduce(DataFrame.unionByName, whole).select(
        F.col("w.hash").alias("hash"), "key", F.col("w.at").alias("at"), size.alias("size"),
        F.exists(F.slice("forms", F.col("w.at") + 1, window), _is_slot).alias("has_slot"),
    )
    windows = stage(windows, "benchmark-windows")
    blocks = -(-windows.count() // broadcast_windows)
    parts = [windows.where(F.pmod("hash", F.lit(blocks)) == b) for b in range(blocks)]
    parts = parts if blocks > 1 else [windows]
    doc, text = named([id_col, text_col])
    places = docs.where(text.isNotNull()).select(
        doc.alias("id"), text.alias("text"),
        F.explode(_entries(forms(text), plain_tokens(text), window, short)).alias("w"),
    ).select("id", "text", F.col("w.at").alias("place"), F.col("w.hash").alias("hash"))
    hits = reduce(
        DataFrame.unionByName,
        [
            places.join(F.broadcast(block), "hash").select(
                "id", row_hash(F.col("text")).alias("row"), "key", "size",
                F.struct((F.col("place") - F.col("at")).alias("shift"), "at").alias("hit"),
                F.when(F.col("has_slot"), F.col("text")).alias("text"),
            )
            for block in parts
        ],
    )
    return _align(hits, items, window, coverage, run)


def _segments(hits: Column, n: Column) -> Column:
    """(p, a, n): stretches of tokens that windows of one shift cover, in the document's order."""

    def add(acc, hit):
        last, end = F.get(acc, F.size(acc) - 1), hit["at"] + n
        grown = F.struct(last["shift"].alias("shift"), last["a"].alias("a"), end.alias("b"))
        new = F.struct(hit["shift"].alias("shift"), hit["at"].alias("a"), end.alias("b"))
        joins = (last["shift"] == hit["shift"]) & (hit["at"] <= last["b"])
        before = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(joins, F.concat(before, F.array(grown))).otherwise(
            F.concat(acc, F.array(new))
        )

    empty = F.array().cast("array<struct<shift:int,a:int,b:int>>")
    return F.sort_array(
        F.transform(
            F.aggregate(hits, empty, add),
            lambda s: F.struct(
                (s["shift"] + s["a"]).alias("p"), s["a"].alias("a"), (s["b"] - s["a"]).alias("n")
            ),
        )
    )


_CHAIN = "array<struct<words:int,p:int,a:int,segs:array<struct<p:int,a:int,n:int>>>>"


def _chains(segments: Column, is_copy, run: int) -> Column:
    """(words, p, a, segs): copies, each the best chain of segments where it stands.

    A chain takes its segments in the order of item and document, at most ``GAP`` tokens
    apart in either; ``words`` counts their tokens, and ``p`` and ``a`` are its ends.
    """

    def chain(words, s, segs):
        return F.struct(
            words.alias("words"), (s["p"] + s["n"]).alias("p"), (s["a"] + s["n"]).alias("a"),
            segs.alias("segs"),
        )

    def after(c, s):
        def trimmed(t):
            fits = (
                (t < s["n"]) & (s["p"] + t - c["p"] <= GAP) & (s["a"] + t - c["a"] <= GAP)
            )
            rest = F.struct(
                (s["p"] + t).alias("p"), (s["a"] + t).alias("a"), (s["n"] - t).alias("n")
            )
            longer = chain(c["words"] + s["n"] - t, s, F.concat(c["segs"], F.array(rest)))
            return F.when(fits, longer)

        # What the chain holds already in item or document is cut from the segment.
        return once(F.greatest(F.lit(0), c["a"] - s["a"], c["p"] - s["p"]), trimmed)

    def add(acc, s):
        open_ = F.filter(acc["open"], lambda c: c["p"] >= s["p"] - GAP)
        closed = F.filter(acc["open"], lambda c: (c["p"] < s["p"] - GAP) & is_copy(c))
        alone = F.array(chain(s["n"], s, F.array(s)))
        best = F.array(
            F.array_max(F.concat(F.transform(acc["open"], lambda c: after(c, s)), alone))
        )
        # Cutting must not cost a run, so a segment that is a copy stays by itself, too.
        own = F.when(s["n"] >= run, alone).otherwise(F.array().cast(_CHAIN))
        return F.struct(
            F.array_distinct(F.concat(open_, best, own)).alias("open"),
            F.concat(acc["done"], closed).alias("done"),
        )

    def start(c):
        return F.get(c["segs"], 0)["p"]

    def pick(acc, x):
        c, last = x["c"], F.get(acc, F.size(acc) - 1)
        before = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return (
            F.when((F.size(acc) == 0) | (start(c) >= last["p"]), F.concat(acc, F.array(c)))
            .when(c["words"] > last["words"], F.concat(before, F.array(c))).otherwise(acc)
        )

    empty = F.array().cast(_CHAIN)
    found = F.aggregate(
        segments, F.struct(empty.alias("open"), empty.alias("done")), add,
        lambda acc: F.concat(acc["done"], F.filter(acc["open"], is_copy)),
    )
    ordered = F.sort_array(
        F.transform(found, lambda c: F.struct(start(c).alias("at"), c.alias("c")))
    )
    return F.aggregate(ordered, empty, pick)


def _align(hits: DataFrame, items: DataFrame, n: int, coverage: float, run: int) -> DataFrame:
    """Chains of window hits that are copies, with their slots checked."""
    met = hits.groupBy("id", "row", "key").agg(
        F.max("size").alias("size"), F.max("text").alias("text"),
        F.sort_array(F.collect_set("hit")).alias("hits"),
    )
    # Too few windows for either rule, however they stand.
    different = F.size(F.array_distinct(F.col("hits")["at"]))
    enough = (different * n >= F.col("size") * coverage) | (different + (n - 1) >= run)

    def is_copy(c):
        return (c["words"] >= F.col("size") * coverage) | F.exists(
            c["segs"], lambda s: s["n"] >= run
        )

    segments = _segments(F.col("hits"), F.least("size", F.lit(n)))
    copies = met.where(enough).select(
        "id", "row", "key", "size", "text",
        F.explode(once(segments, lambda s: _chains(s, is_copy, run))).alias("c"),
    )
    segs = F.col("c.segs")

    def slot_places(s):
        tokens = F.sequence(s["a"], s["a"] + s["n"] - 1)
        return F.filter(tokens, lambda p: _is_slot(F.get("forms", p)))

    def slots(raws):
        return F.flatten(F.transform(segs, lambda s: F.transform(
            slot_places(s),
            lambda p: F.struct(
                F.get("forms", p).alias("type"), F.lower(F.get("raws", p)).alias("of_item"),
                F.lower(F.get(raws, p + s["p"] - s["a"])).alias("of_doc"),
            ),
        )))

    def plain(s):
        """Whether ``run`` words between two slots lie in the segment."""
        first, last = F.array(s["a"] - 1), F.array(s["a"] + s["n"])
        return once(
            F.concat(first, slot_places(s), last),
            lambda cuts: F.exists(
                F.transform(cuts, lambda p, i: F.get(cuts, i + 1) - p - 1),
                lambda words: F.coalesce(words >= run, F.lit(False)),
            ),
        )

    filled = copies.join(items, "key").withColumn(
        "slots",
        F.when(F.col("text").isNull(), F.array().cast(
            "array<struct<type:string,of_item:string,of_doc:string>>"
        )).otherwise(once(raw_tokens(F.col("text")), slots)),
    )
    pairs = F.array_distinct("slots")
    ones = F.array_distinct(F.transform("slots", lambda s: F.struct(s["type"], s["of_item"])))
    consistent = F.size(pairs) == F.size(ones)
    equal = F.size(F.filter("slots", lambda s: s["of_item"].eqNullSafe(s["of_doc"])))
    kind = (
        F.when(F.forall("slots", lambda s: s["of_item"].eqNullSafe(s["of_doc"])), "exact")
        .when(consistent & (F.col("c.words") - F.size("slots") >= SAID * F.col("c.words")), "reparameterised")
        .when(equal >= SAME * F.size("slots"), "edited")
        .when(F.exists(segs, plain), "partial")
    )
    kinds = F.create_map(*[F.lit(x) for pair in PLACEHOLDERS.items() for x in pair])
    return filled.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "id", "row", "item", F.get(segs, 0)["p"].cast("long").alias("start"),
        F.col("c.p").cast("long").alias("end"), (F.col("c.words") / F.col("size")).alias("coverage"),
        F.transform(
            "slots",
            lambda s: F.struct(F.element_at(kinds, s["type"]).alias("type"), s["of_item"], s["of_doc"]),
        ).alias("slots"),
        "kind",
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents, as told by their ids, that hold a copy of a benchmark item."""
    doc = named([id_col])[0]
    name = fresh(["_hit"], docs.columns)[0]
    hit = stage(
        find_copies(docs, benchmark, id_col, **options).select(F.col("id").alias(name)).distinct(),
        "benchmark-hits",
    )
    return docs.join(hit, doc.eqNullSafe(F.col(name)), "left_anti")


def clean_rows(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` without the rows that hold a copy; others of the same or no id stay."""
    doc, text = named([id_col, text_col])
    name, row = fresh(["_hit", "_row"], docs.columns)
    hit = stage(
        find_copies(docs, benchmark, id_col, text_col, **options)
        .select(F.col("id").alias(name), F.col("row").alias(row)).distinct(),
        "benchmark-hits",
    )
    same = doc.eqNullSafe(F.col(name)) & (row_hash(text) == F.col(row)) & text.isNotNull()
    return docs.join(hit, same, "left_anti")
