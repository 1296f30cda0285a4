"""Line dedup by overlapping three-line windows.

Lines are what stands between line feeds, as they are. Every three consecutive lines of a
document are a window. Of equal windows the first one, by document id and then by place,
stays; of every later one all three lines are covered, and covered lines go. Windows of
blank lines only are not looked at, so blank lines between paragraphs stay.

Defined results: a null text stays null and has 0 lines; a text of fewer lines than a window
keeps all; rows that repeat a document id are told apart by a hash of their text, and rows
equal in both count as one document, so they get the same result; a null id comes first;
other columns pass through whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions.columns import named
from pagesift.sources.staging import stage

WINDOW_LINES = 3


def _lines(text_col: str):
    return F.split(named([text_col])[0], "\n", -1)


def fresh(names: list[str], taken: list[str]) -> list[str]:
    """``names`` lengthened until none is among ``taken``, whatever the case of letters."""
    have = {c.lower() for c in taken}
    while any(n.lower() in have for n in names):
        names = [n + "_" for n in names]
    return names


def once(value, use):
    """``use(value)`` with the value computed once a row, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def line_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW_LINES
) -> DataFrame:
    """(id, th, place, h1, h2): the windows of all documents, places counted from 0.

    ``th`` is a hash of the whole text, ``h1`` and ``h2`` are two hashes of the window.
    """
    doc, text = named([id_col, text_col])
    def window(lines, i):
        three = [F.get(lines, i + k) for k in range(n)]
        blank = F.trim(F.concat(*three)) == ""
        return F.when(
            ~blank,
            F.struct(
                i.cast("int").alias("place"), F.xxhash64(F.lit(1), *three).alias("h1"),
                F.xxhash64(F.lit(2), *three).alias("h2"),
            ),
        )

    def windows(lines):
        last = F.size(lines) - n
        places = F.when(last >= 0, F.sequence(F.lit(0), last))
        return F.coalesce(F.transform(places, lambda i: window(lines, i)), F.array())

    rows = docs.where(text.contains("\n"))
    hashed = rows.select(
        doc.alias("id"), F.xxhash64(text).alias("th"),
        F.explode(once(_lines(text_col), windows)).alias("w"),
    )
    return hashed.where(F.col("w").isNotNull()).select("id", "th", "w.*")


def covering_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW_LINES
) -> DataFrame:
    """(id, th, starts): where the later occurrences of windows begin, by document.

    The repeated windows are found by an aggregate that combines before its shuffle and
    are written; the join with all windows is then one of two plain shuffles, whose hot
    keys adaptive execution splits.
    """
    windows = stage(line_windows(docs, id_col, text_col, n), "line-windows")
    occurrence = F.struct("id", "th", "place")
    first = stage(
        windows.groupBy("h1", "h2").agg(F.min(occurrence).alias("first"), F.count("*").alias("n"))
        .where(F.col("n") > 1).select("h1", "h2", "first"),
        "line-repeats",
    )
    later = windows.join(first, ["h1", "h2"]).where(~occurrence.eqNullSafe(F.col("first")))
    return later.groupBy("id", "th").agg(F.collect_set("place").alias("starts"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW_LINES
) -> DataFrame:
    """``docs`` without the covered lines, and ``n_lines`` (before) and ``n_removed``.

    The two counts replace columns of those names.
    """
    doc, text = named([id_col, text_col])
    names = fresh(["_id", "_th", "_starts", "_kept"], docs.columns)
    i, th, begin, left = (F.col(n) for n in names)
    starts = covering_windows(docs, id_col, text_col, n).toDF(*names[:3])
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    same = doc.eqNullSafe(i) & (F.xxhash64(text) == th)
    lines, some = _lines(text_col), begin.isNotNull()

    def kept(lines):
        # A window covers the lines from its start on; the rest is set difference, in order.
        gone = F.flatten(F.transform(begin, lambda s: F.sequence(s, s + (n - 1))))
        rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        texts = F.array_join(F.transform(rest, lambda k: F.get(lines, k)), "\n")
        return F.struct(texts.alias("text"), F.size(rest).alias("n"))

    joined = docs.select(*named(keep)).join(starts, same, "left").withColumn(
        names[3], F.when(some, once(lines, kept))
    )
    new_text = F.when(some, left["text"]).otherwise(text)
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    n_removed = F.when(some, F.size(lines) - left["n"]).otherwise(0).cast("long")
    return joined.select(
        *[new_text.alias(c) if c == text_col else named([c])[0]
          for c in keep],
        n_lines.alias("n_lines"), n_removed.alias("n_removed"),
    )


def oracle(n: int = WINDOW_LINES, table: str = "documents") -> str:
    """DuckDB SQL for ``doc_id, text, n_lines, n_removed`` of a table with unique ids."""
    ahead = " || chr(10) || ".join(
        ["line"] + [f"lead(line, {k}) OVER w" for k in range(1, n)]
    )
    return f"""
WITH pieces AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS place
    FROM {table} WHERE text IS NOT NULL),
windows AS (
    SELECT doc_id, place, {ahead} AS content FROM pieces
    WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
ranked AS (
    SELECT doc_id, place,
           row_number() OVER (PARTITION BY content ORDER BY doc_id, place) AS nth
    FROM windows WHERE content IS NOT NULL
      AND trim(replace(content, chr(10), '')) <> ''),
gone AS (
    SELECT DISTINCT doc_id, place + k AS place
    FROM ranked, (SELECT unnest(range({n})) AS k) WHERE nth > 1),
result AS (
    SELECT p.doc_id, string_agg(line, chr(10) ORDER BY p.place) FILTER (g.place IS NULL) AS text,
           count(*) AS n_lines, count(g.place) AS n_removed
    FROM pieces p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.place = p.place
    GROUP BY p.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(r.text, '') END AS text,
       coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed
FROM {table} d LEFT JOIN result r USING (doc_id)"""
