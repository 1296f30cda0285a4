"""Inputs the queries derive from the given tables, as DataFrames and as SQL.

Each input is defined twice, once for Spark and once as a DuckDB common table
expression, from the same replacement lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.operators.categorize import KEYWORDS, keyword_category

TITLES = (
    "About the company", "Our products", "Key features", "Pricing plans", "Customer reviews",
    "Contact us", "Related Products", "Latest news", "Privacy policy",
    "Product <b>guide</b>&nbsp;2", None, "Overview",
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- sections made of documents -------------------------------------------------


def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``h1`` per document with its whole text and one sub-section per line."""
    docs = table(spark, sf_dir, "documents")
    parts = F.concat(F.array("text"), F.split("text", "\n"))
    rows = docs.select("doc_id", "source", F.posexplode(parts).alias("i", "content")).where(
        (F.col("i") == 0) | (F.col("content") != "")
    )
    i, pick = F.col("i"), (F.col("doc_id") * 7 + F.col("i")) % 12
    titles = F.array(*[F.lit(t) for t in TITLES])
    title = F.coalesce(F.get(titles, pick.cast("int")), F.col("content"))
    level = F.when(i == 0, "h1").otherwise(F.concat(F.lit("h"), (2 + (i - 1) % 5).cast("string")))
    folder = F.floor(F.col("doc_id") / 40).cast("string")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), folder)
    return rows.select(
        url.alias("url"), (F.col("doc_id") * 100000 + i).alias("pos"),
        title.alias("section_title"), level.alias("section_level"), "content",
    ).withColumn("ai_category", keyword_category("section_title"))


def category_sql(title: str, keywords=KEYWORDS) -> str:
    cases = " ".join(
        f"WHEN {' OR '.join(f'contains(lower({title}), {quoted(w)})' for w in words)} "
        f"THEN {quoted(c)}"
        for c, words in keywords.items()
    )
    return f"CASE {cases} ELSE 'Other' END"


_TITLE_CASES = " ".join(
    f"WHEN {i} THEN {quoted(t) if t else 'content'}" for i, t in enumerate(TITLES)
)
DOC_SECTIONS = f"""
doc_parts AS (
  SELECT doc_id, source, unnest(list_prepend(text, string_split(text, chr(10)))) AS content,
         unnest(range(len(string_split(text, chr(10))) + 1)) AS i
  FROM documents),
doc_titled AS MATERIALIZED (
  SELECT *, CASE (doc_id * 7 + i) % 12 {_TITLE_CASES} END AS section_title
  FROM doc_parts WHERE i = 0 OR content <> ''),
doc_sections AS (
  SELECT 'https://' || source || '.example.com/' || (doc_id // 40) AS url,
         doc_id * 100000 + i AS pos, section_title,
         CASE WHEN i = 0 THEN 'h1' ELSE 'h' || (2 + (i - 1) % 5) END AS section_level, content,
         {category_sql("section_title")} AS ai_category
  FROM doc_titled)"""

# --- pages with more kinds of layout than the given ones -------------------------

# What is replaced in the html, in order, by page_id % 7.
LAYOUTS: dict[int, tuple[tuple[str, str], ...]] = {
    # end tags that close nothing
    0: (("</p><p>", "</p></ul><p>"), ("</h1>", "</td></h1></section>"), ("<br>", "</table><br>")),
    # headings of three levels, and one without a title
    1: (
        ("</p><p>", "</p><h3>Product <i>detail</i></h3><p>"),
        ("<br>", "<h2>Key features</h2><h4> </h4>"),
        ("<h1>", "<h1>About us: "),
        ("<article>", "<article><div class='wide Content-Area'>"), ("</article>", "</div></article>"),
    ),
    # the heading in a column, its text beside the column
    2: (("<article><h1>", '<article><div class="col"><h1>'), ("</h1>", "</h1></div>")),
    # no heading; main element on every second one (below)
    3: (("<h1>", "<p>"), ("</h1>", "</p>")),
    # the heading in a cell of a row, its text beside the row
    4: (
        ("<article><h1>", '<article><div class="row"><div class="cell"><h1>'),
        ("</h1>", "</h1><!-- c --></div></div><a href='/x'>first</a> <em>second <u>third</u></em>"),
        ("<h1>", "<h1>Our services "),
    ),
    # the heading too deep for its text, in a box
    5: (
        ("<article><h1>", '<article><section data-y="a class=none" class="Big-Card x"><div><div><h1>'),
        ("</h1>", "</h1></div></div></section>"), ("<h1>", "<h1>News: "),
    ),
    # the heading in a table cell, its text in the next one
    6: (
        ("<article><h1>", "<article><table><tr><td><h1>Partner "),
        ("</h1>", "</h1></td><td>Size <b>5</b></td></tr><tr><td>no part</td></tr></table>"),
    ),
}
# Elements that are closed late or never, beside others of the same name, by page_id % 11.
OPEN: dict[int, tuple[tuple[str, str], ...]] = {
    4: (("</p><p>", "</p><table><tr><td>a<td>b</td></tr></table><p>"), ("<br>", "<ul><li>c<li>d</ul>")),
    2: (("<br>", "<div class='card'><ul><li>g</ul><h2>Our services</h2><p>h</p></li><p>i</p></div>"),),
    5: (("</p><p>", "</p><table><tr><td>j</div><td>k<tr><th>l</table></tr><dl><dt>m<dd>n</dl></dd><p>"),
        ("</h1>", "</h1><section class='box'><div><ol><li>o</section></ol><p>p</p></div>")),
    7: (("</h1>", "</h1><div>open "), ("</p><p>", "</p><ol><li>e</ol><section><p>f</section><p>")),
}
MAIN = (("<article>", "<main>"), ("</article>", "</main>"))  # where page_id % 14 = 3
# Metadata put behind the charset, by page_id % 4; N stands for the page_id.
META: dict[int, str] = {
    0: '<meta content="set name=description here" name="keywords"><meta content="About &amp; more N" name="description">'
    '<link rel="alternate canonical" href="https://canon.example.com/N">',
    1: "<meta name='description' content=''><meta property=\"og:description\" content=\"Social N\">",
    2: '<meta data-x="1 content=bad" name="description" content="Plain N"><meta property="og:description" content="S">'
    "<link rel=stylesheet href=x.css><link href='/p/N' rel='canonical'>",
}
CHARSET = '<meta charset="utf-8">'
EMPTY_HTML = "<html><body><div><br></div><script>var a = 1;</script></body></html>"


def _replaced(c, pairs):
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _replaced_sql(c: str, pairs) -> str:
    for old, new in pairs:
        c = f"replace({c}, {quoted(old)}, {quoted(new)})"
    return c


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    html, page_id = F.col("html"), F.col("page_id")
    out = html
    for rest, pairs in LAYOUTS.items():
        out = F.when(page_id % 7 == rest, _replaced(html, pairs)).otherwise(out)
    for rest, pairs in OPEN.items():
        out = F.when(page_id % 11 == rest, _replaced(out, pairs)).otherwise(out)
    out = F.when(page_id % 14 == 3, _replaced(out, MAIN)).otherwise(out)
    meta = F.lit("")
    for rest, text in META.items():
        numbered = F.replace(F.lit(text), F.lit("N"), page_id.cast("string"))
        meta = F.when(page_id % 4 == rest, numbered).otherwise(meta)
    out = F.replace(out, F.lit(CHARSET), F.concat(F.lit(CHARSET), meta))
    out = F.when(page_id % 25 == 1, F.lit(EMPTY_HTML)).when(page_id % 25 == 2, F.lit("")).otherwise(out)
    return pages.select("page_id", "url", out.alias("html"))


def _layout_sql() -> str:
    cases = " ".join(
        f"WHEN {rest} THEN {_replaced_sql('html', pairs)}" for rest, pairs in LAYOUTS.items()
    )
    metas = " ".join(
        f"WHEN {rest} THEN replace({quoted(text)}, 'N', page_id::VARCHAR)"
        for rest, text in META.items()
    )
    opened = " ".join(
        f"WHEN {rest} THEN {_replaced_sql('html', pairs)}" for rest, pairs in OPEN.items()
    )
    return f"""
first_layout AS (
  SELECT page_id, url, CASE page_id % 7 {cases} ELSE html END AS html,
         CASE page_id % 4 {metas} ELSE '' END AS meta FROM pages),
laid_out AS (
  SELECT page_id, url, CASE page_id % 11 {opened} ELSE html END AS html, meta FROM first_layout),
layout_pages AS MATERIALIZED (
  SELECT page_id, url,
    CASE WHEN page_id % 25 = 1 THEN {quoted(EMPTY_HTML)} WHEN page_id % 25 = 2 THEN ''
    ELSE replace(CASE WHEN page_id % 14 = 3 THEN {_replaced_sql('html', MAIN)} ELSE html END,
                 {quoted(CHARSET)}, {quoted(CHARSET)} || meta) END AS html
  FROM laid_out)"""


LAYOUT_PAGES = _layout_sql()

# --- URL lists --------------------------------------------------------------------


def listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A URL table as people keep them: an odd header, dirt, repeats, other columns.

    Every page is listed once with dirt that depends on its id; each third one is
    listed again, and each fifth one with an address nobody has stored.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    i, url = F.col("page_id"), F.col("url")
    bare = F.regexp_replace(url, "^https?://", "")
    dirty = (
        F.when(i % 7 == 0, bare)
        .when(i % 7 == 1, F.concat(F.lit(" \t"), url, F.lit(" ")))
        .when(i % 7 == 2, F.concat(F.lit("http://user@"), bare))
        .when(i % 7 == 3, F.lit("localhost"))
        .when(i % 7 == 4, F.regexp_replace(url, "(//[^/]*)", "$1:8080"))
        .when(i % 7 == 5, F.lit("   "))
        .otherwise(url)
    )
    kinds = F.array(
        F.struct(F.lit(0).alias("k"), dirty.alias("Website")),
        F.struct(F.lit(1).alias("k"), F.when(i % 3 == 0, url).alias("Website")),
        F.struct(
            F.lit(2).alias("k"),
            F.when(i % 5 == 0, F.concat(url, F.lit("/missing"))).alias("Website"),
        ),
    )
    rows = pages.select("page_id", F.inline(kinds))
    return rows.select(
        (F.col("page_id") * 3 + F.col("k")).alias("row_id"),
        F.concat(F.lit("Site "), F.col("page_id") % 10).alias("Site Name"),
        "Website",
        (F.col("page_id") + F.col("k")).alias("Rank"),
    )


LISTED_URLS = """
listed_urls AS (
  SELECT page_id * 3 + k AS row_id, 'Site ' || (page_id % 10) AS "Site Name",
    CASE k WHEN 1 THEN CASE WHEN page_id % 3 = 0 THEN url END
           WHEN 2 THEN CASE WHEN page_id % 5 = 0 THEN url || '/missing' END
    ELSE CASE page_id % 7
      WHEN 0 THEN regexp_replace(url, '^https?://', '')
      WHEN 1 THEN ' ' || chr(9) || url || chr(160)
      WHEN 2 THEN 'http://user@' || regexp_replace(url, '^https?://', '')
      WHEN 3 THEN 'localhost'
      WHEN 4 THEN regexp_replace(url, '(//[^/]*)', '\\1:8080')
      WHEN 5 THEN '   '
      ELSE url END END AS "Website",
    page_id + k AS "Rank"
  FROM pages, (VALUES (0), (1), (2)) AS kinds(k))"""
