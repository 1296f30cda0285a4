"""Every query with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checks import sql as Q
from checks.fixtures import (
    DOC_SECTIONS, LAYOUT_PAGES, LISTED_URLS, category_sql, doc_sections, layout_pages,
    listed_urls, quoted, table,
)
from pagesift.functions import text as T
from pagesift.functions import urls as U
from pagesift.functions.html import strip_elements
from pagesift.operators import categorize as C
from pagesift.operators import dedup as D
from pagesift.operators import enrich as E
from pagesift.operators import filters as FL
from pagesift.operators import numbering as N
from pagesift.operators import reports as R
from pagesift.operators import rule_tables as RT
from pagesift.operators import sections as S
from pagesift.plans.site_report import (
    listed_sections, report_prompts, site_report, submitted_report,
)
from pagesift.sources import outputs as O
from pagesift.sources import pages as P
from pagesift.sources import rules as RU
from pagesift.sources import urls as SU
from pagesift.sources.staging import new_folder, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


# --- text -----------------------------------------------------------------------------


@register("clean_text", Q.with_(DOC_SECTIONS) + f"""
SELECT pos, {Q.clean('section_title')} AS section_title, {Q.clean('content')} AS content
FROM doc_sections""")
def _clean_text(spark, sf):
    ds = doc_sections(spark, sf)
    return ds.select(
        "pos", T.clean_text("section_title").alias("section_title"),
        T.clean_text("content").alias("content"),
    )


@register("strip_phrases", Q.with_(DOC_SECTIONS, f"""
noisy AS (SELECT pos, CASE pos % 4
    WHEN 0 THEN 'READ more ' || content || ' /$top$ Anchor 12 click HERE'
    WHEN 1 THEN content || ' Loading...Please wait...$w .Click Read morehere'
    WHEN 2 THEN 'Skip to main content ' || content || ' $ $ Accept Cookies'
    ELSE content END AS content FROM doc_sections)""") + f"""
SELECT pos, {Q.strip_phrases(Q.clean('content'))} AS content FROM noisy""")
def _strip_phrases(spark, sf):
    c, rest = F.col("content"), F.col("pos") % 4
    noisy = (
        F.when(rest == 0, F.concat(F.lit("READ more "), c, F.lit(" /$top$ Anchor 12 click HERE")))
        .when(rest == 1, F.concat(c, F.lit(" Loading...Please wait...$w .Click Read morehere")))
        .when(
            rest == 2,
            F.concat(F.lit("Skip to main content "), c, F.lit(" $ $ Accept Cookies")),
        )
        .otherwise(c)
    )
    ds = doc_sections(spark, sf).select("pos", noisy.alias("content"))
    phrases = RU.DEFAULT_RULES.boilerplate_phrases
    return ds.select("pos", T.strip_phrases(T.clean_text("content"), phrases).alias("content"))


@register("word_count", f"""
SELECT doc_id, ({Q.words(Q.collapse("coalesce(text, '')"))})::INT AS n_words FROM documents""")
def _word_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_count("text").alias("n_words"))


@register("flatten_newlines", f"""
SELECT conv_id, turn, {Q.strip("replace(text, chr(10), ' | ')")} AS file_text,
       {Q.strip("replace(text, chr(10), ' ')")} AS export_text FROM conversations""")
def _flatten_newlines(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", T.flatten_newlines("text").alias("file_text"),
        T.flatten_newlines("text", " ").alias("export_text"),
    )


_ENTITY_ROWS = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in T.ENTITIES.items())
_LOOSE_ROWS = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in T.LOOSE_ENTITIES.items())


def _entities(start: str, *pairs: tuple[str, str]) -> tuple[str, Query]:
    """Texts with references put in, and what they are decoded to."""
    text = Q.replaced("text", pairs)
    sql = f"""
WITH coded AS (SELECT doc_id, {quoted(start)} || {text} AS text FROM documents),
entities(name, ch) AS (VALUES {_ENTITY_ROWS}), loose(name, ch) AS (VALUES {_LOOSE_ROWS}),
parts AS (SELECT doc_id, unnest(string_split(text, '&')) AS p,
                 unnest(range(len(string_split(text, '&')))) AS i FROM coded),
told AS (SELECT *, regexp_extract(p, '^(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);', 1) AS n,
           regexp_extract(p, '^[a-zA-Z0-9]+') AS letters,
           regexp_extract(p, '^(#[0-9]+|#[xX][0-9a-fA-F]+)') AS code FROM parts),
kinds AS (SELECT letters, max_by(name, length(name)) AS short
  FROM (SELECT DISTINCT letters FROM told) JOIN loose ON starts_with(letters, name) GROUP BY ALL),
solved AS (SELECT t.*, CASE code WHEN '#0' THEN chr(65533) WHEN '#8212' THEN chr(8212)
    WHEN '#65' THEN 'A' WHEN '#x4a' THEN 'J' WHEN '#x1F600' THEN chr(128512) END AS sign,
    e.ch AS exact, short, l.ch AS open_ch
  FROM told t LEFT JOIN entities e ON t.n = e.name LEFT JOIN kinds USING (letters)
  LEFT JOIN loose l ON l.name = short)
SELECT doc_id, string_agg(CASE WHEN i = 0 THEN p
  WHEN sign IS NOT NULL THEN sign || p[length(code) + CASE WHEN n = '' THEN 1 ELSE 2 END:]
  WHEN exact IS NOT NULL THEN exact || p[length(n) + 2:]
  WHEN short IS NOT NULL THEN open_ch || regexp_replace(p[length(short) + 1:], '^;', '')
  ELSE '&' || p END, '' ORDER BY i) AS text FROM solved GROUP BY doc_id"""

    def run(spark, sf):
        text = F.col("text")
        for old, new in pairs:
            text = F.replace(text, F.lit(old), F.lit(new))
        coded = F.concat(F.lit(start), text)
        docs = table(spark, sf, "documents").select("doc_id", coded.alias("text"))
        return docs.select("doc_id", T.decode_entities("text").alias("text"))

    return sql, run


for _name, *_how in (
    ("entity_decode", "&lt;p&gt;", ("e ", "e&amp;nbsp;&#8212;"),
     ("n ", "n&#x1F600;&eacute;&copy 2 &nosuch; &#0;&")),
    ("entity_without_end", "&ltp&gt", ("e ", "e&copy2024 &ampx&amp "), ("n ", "n&#65 &#x4ag&notit;&notin;"),
     ("s ", "s&eacuteee&no;&reg=&")),
):
    _sql, _run = _entities(*_how)
    register(_name, _sql)(_run)


# --- row filters ----------------------------------------------------------------------

_ROWS = "url, pos, section_title, section_level, content, ai_category"


def _step(step: str, source=doc_sections) -> Query:
    def run(spark, sf):
        return FL.keep_rows(source(spark, sf), steps=[step]).select(*_ROWS.split(", "))

    return run


for _name, _stepname in (
    ("filter_category", "category"), ("filter_keywords", "keyword"), ("filter_titles", "title"),
    ("filter_min_words", "words"),
):
    register(_name, Q.with_(DOC_SECTIONS, Q.cleaned("doc_sections")) + f"""
SELECT {_ROWS} FROM cleaned WHERE NOT {Q.FAILS[_stepname]}""")(_step(_stepname))


def _product_links(spark, sf):
    same = F.when(F.col("pos") % 2 == 0, F.col("section_title")).otherwise(
        F.concat("section_title", F.lit(" Best"))
    )
    return doc_sections(spark, sf).withColumn(
        "content", F.when(F.col("pos") % 9 == 0, same).otherwise(F.col("content"))
    )


register("filter_product_link", Q.with_(DOC_SECTIONS, """
links AS (SELECT * REPLACE (CASE WHEN pos % 9 <> 0 THEN content WHEN pos % 2 = 0
    THEN section_title ELSE section_title || ' Best' END AS content) FROM doc_sections)""",
    Q.cleaned("links")) + f"""
SELECT {_ROWS} FROM cleaned WHERE NOT {Q.FAILS['product_link']}""")(
    _step("product_link", _product_links)
)


@register("filter_sections", Q.with_(
    DOC_SECTIONS, Q.cleaned("doc_sections"), Q.filtered("cleaned")) + f"""
SELECT {_ROWS} FROM kept""")
def _filter_sections(spark, sf):
    return FL.filter_sections(doc_sections(spark, sf), order_by=["pos"]).select(*_ROWS.split(", "))


_REASON = " ".join(f"WHEN {test} THEN {quoted(step)}" for step, test in Q.FAILS.items())


@register("filter_step_report", Q.with_(
    DOC_SECTIONS, Q.cleaned("doc_sections"), Q.filtered("cleaned"), f"""
reasons AS (SELECT CASE {_REASON} END AS reason FROM cleaned),
steps(step) AS (VALUES {', '.join(f'({quoted(s)})' for s in (*FL.STEPS, 'kept'))})""") + """
SELECT step, CASE step WHEN 'kept' THEN (SELECT count(*) FROM kept)
  WHEN 'duplicate' THEN (SELECT count(*) FROM alive) - (SELECT count(*) FROM uniq)
  WHEN 'page_dump' THEN (SELECT count(*) FROM uniq) - (SELECT count(*) FROM kept)
  ELSE (SELECT count(*) FROM reasons WHERE reason = step) END AS n_rows FROM steps""")
def _filter_step_report(spark, sf):
    return FL.step_report(doc_sections(spark, sf), order_by=["pos"])


@register("filter_with_report", Q.with_(
    DOC_SECTIONS, Q.cleaned("doc_sections"), Q.filtered("cleaned")) + """
SELECT url, pos, section_title, section_level, content, ai_category,
  (SELECT count(*) FROM doc_sections) AS original_rows,
  (SELECT count(*) FROM kept) AS filtered_rows FROM kept""")
def _filter_with_report(spark, sf):
    kept, report = FL.filter_with_report(doc_sections(spark, sf), order_by=["pos"])
    n = R.report_summary(report).first()
    return kept.select(
        *_ROWS.split(", "), F.lit(n.original_rows).cast("long").alias("original_rows"),
        F.lit(n.filtered_rows).cast("long").alias("filtered_rows"),
    )


@register("rules_overlay", """
WITH given AS (
  SELECT 'sources' AS rule_type, source AS pattern, count(*) AS n_docs FROM documents GROUP BY ALL),
defaults AS (
  SELECT 'sources' AS rule_type, lang AS pattern, count(*) AS n_docs FROM documents GROUP BY ALL
  UNION ALL SELECT 'langs', lang, count(*) FROM documents GROUP BY ALL),
both_ AS (SELECT * FROM given UNION ALL
  SELECT * FROM defaults WHERE rule_type NOT IN (SELECT rule_type FROM given))
SELECT rule_type, pattern,
  (row_number() OVER (PARTITION BY rule_type ORDER BY pattern))::INT - 1 AS ord FROM both_""")
def _rules_overlay(spark, sf):
    docs = table(spark, sf, "documents")

    def found(rule_type: str, column: str) -> DataFrame:
        patterns = docs.groupBy(F.col(column).alias("pattern")).agg(F.count("*").alias("n"))
        # One row per language or source; the window sorts those few only.
        ord_ = F.row_number().over(W.partitionBy("rule_type").orderBy("pattern")) - 1
        return (
            patterns.withColumn("rule_type", F.lit(rule_type)).withColumn("ord", ord_).drop("n")
        )

    defaults = found("sources", "lang").unionByName(found("langs", "lang"))
    return RU.overlay_rules(found("sources", "source"), defaults)


_USER_RULES = {
    "min_word_count": 9, "excluded_section_titles": ["pricing", "overview"],
    "boilerplate_keywords": ["licensed under", "erat"],
}
_OVERLAID = RU.FilterRules(**{
    **vars(RU.DEFAULT_RULES), **{k: v if k == "min_word_count" else tuple(v)
                                 for k, v in _USER_RULES.items()},
})


@register("filter_custom_rules", Q.with_(
    DOC_SECTIONS, Q.cleaned("doc_sections"), Q.filtered("cleaned", rules=_OVERLAID)) + f"""
SELECT {_ROWS} FROM kept""")
def _filter_custom_rules(spark, sf):
    user, defaults = (RU.rules_table(spark, r) for r in (_USER_RULES, RU.DEFAULT_RULES))
    rules = RU.rules_from_table(RU.overlay_rules(user, defaults))
    kept = FL.filter_sections(doc_sections(spark, sf), rules, order_by=["pos"])
    return kept.select(*_ROWS.split(", "))


# Rules made of stretches of the texts themselves, of names that occur nowhere, and short ones.
_MADE_RULES = """
made_rules AS (
  SELECT 'boilerplate_keywords' AS rule_type, lower(content[5:20]) AS pattern
  FROM doc_sections WHERE pos % 97 = 3 AND length(content) >= 20
  UNION SELECT 'boilerplate_keywords', lower(c_name) FROM customer
  UNION SELECT 'excluded_section_titles', lower(r_name[1:3]) FROM region
  UNION SELECT 'excluded_section_titles', lower(content[1:9]) FROM doc_sections
    WHERE pos % 101 = 5 AND length(content) >= 9)"""


def _made_rules(spark, sf) -> DataFrame:
    ds = doc_sections(spark, sf)
    pos, size = F.col("pos"), F.length("content")
    keyword, title = F.lit("boilerplate_keywords"), F.lit("excluded_section_titles")
    parts = (
        ds.where((pos % 97 == 3) & (size >= 20)).select(keyword, F.lower(F.substring("content", 5, 16))),
        table(spark, sf, "customer").select(keyword, F.lower("c_name")),
        table(spark, sf, "region").select(title, F.lower(F.substring("r_name", 1, 3))),
        ds.where((pos % 101 == 5) & (size >= 9)).select(title, F.lower(F.substring("content", 1, 9))),
    )
    rules = parts[0].toDF("rule_type", "pattern")
    for part in parts[1:]:
        rules = rules.unionByName(part.toDF("rule_type", "pattern"))
    return stage(rules.distinct(), "made-rules")


@register("filter_rule_table", Q.with_(DOC_SECTIONS, Q.cleaned("doc_sections"), _MADE_RULES) + f"""
SELECT {_ROWS} FROM cleaned c WHERE NOT EXISTS (
    SELECT 1 FROM made_rules r WHERE rule_type = 'boilerplate_keywords'
      AND contains(lower(c.section_title || ' ' || c.content), r.pattern))
  AND NOT EXISTS (
    SELECT 1 FROM made_rules r WHERE rule_type = 'excluded_section_titles'
      AND contains(lower(c.section_title), r.pattern))""")
def _filter_rule_table(spark, sf):
    kept = RT.filter_by_rule_table(doc_sections(spark, sf), _made_rules(spark, sf), ["pos"])
    return kept.select(*_ROWS.split(", "))


@register("rule_table_hits", Q.with_(DOC_SECTIONS, _MADE_RULES) + """
SELECT pattern, count(*) AS n_rows
FROM doc_sections JOIN (SELECT DISTINCT pattern FROM made_rules) ON contains(lower(content), pattern)
GROUP BY pattern""")
def _rule_table_hits(spark, sf):
    hits = RT.rule_hits(
        doc_sections(spark, sf), ["pos"], F.lower("content"), _made_rules(spark, sf)
    )
    return hits.groupBy("pattern").agg(F.count("*").alias("n_rows"))


# --- repeats and page dumps -----------------------------------------------------------


@register("dedup_first", Q.with_(
    DOC_SECTIONS, Q.cleaned("doc_sections"), Q.uniq("cleaned")) + f"""
SELECT {_ROWS} FROM uniq""")
def _dedup_first(spark, sf):
    return D.first_wins(FL.clean_sections(doc_sections(spark, sf)), ["pos"])


def _unique(spark, sf):
    return stage(D.first_wins(FL.clean_sections(doc_sections(spark, sf)), ["pos"]), "unique")


_DUMPS = Q.with_(DOC_SECTIONS, Q.cleaned("doc_sections"), Q.uniq("cleaned"), Q.dumps("uniq"))


@register("page_dump_detect", _DUMPS + f" SELECT {_ROWS} FROM dumps")
def _page_dump_detect(spark, sf):
    return D.page_dumps(_unique(spark, sf))


@register("page_dump_remove", _DUMPS + f"""
SELECT {_ROWS} FROM uniq WHERE (url, section_title, section_level) NOT IN (
  SELECT (url, section_title, section_level) FROM dumps)""")
def _page_dump_remove(spark, sf):
    return D.remove_page_dumps(_unique(spark, sf))


# --- categories -----------------------------------------------------------------------


@register("categorize_keywords", Q.with_(DOC_SECTIONS) + f"""
SELECT pos, {category_sql('section_title')} AS by_title, {category_sql('content')} AS by_content
FROM doc_sections""")
def _categorize_keywords(spark, sf):
    return doc_sections(spark, sf).select(
        "pos", C.keyword_category("section_title").alias("by_title"),
        C.keyword_category("content").alias("by_content"),
    )


_OWN = {"English": (" the ", " of "), "German": (" der ", " und "), "Short": ("a",)}


@register("categorize_custom", f"""
SELECT doc_id, {category_sql('text', _OWN)} AS category FROM documents""")
def _categorize_custom(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", C.keyword_category("text", _OWN).alias("category")
    )


_NUMBERED = Q.with_(DOC_SECTIONS, """
numbered AS (SELECT *, row_number() OVER (ORDER BY pos) AS row_no FROM doc_sections),
batched AS (SELECT *, (row_no - 1) // 20 AS batch_id, ((row_no - 1) % 20)::INT AS batch_pos
            FROM numbered)""")


def _numbered(spark, sf) -> DataFrame:
    return N.with_row_number(doc_sections(spark, sf), ["pos"])


@register("prompt_batches", _NUMBERED + f"""
SELECT batch_id, count(*) AS n_sections,
  'Categorize each of the following website sections into one of these categories:' || chr(10)
  || chr(10) || {" || chr(10) || ".join(quoted('- ' + c) for c in C.CATEGORIES)} || chr(10)
  || chr(10) || 'Sections to categorize:' || chr(10)
  || string_agg((batch_pos + 1) || '. Title: "' || section_title || '" | Content preview: "'
       || content[1:200] || '..."', chr(10) ORDER BY batch_pos) || chr(10) || chr(10)
  || 'Respond with a JSON array of category strings in the same order as the input sections.'
  || chr(10) || 'Only use categories from the list provided. If unsure, use "Other".' || chr(10)
  || 'Example response: ["About/Company Overview", "Products/Services", "Contact Information"]'
  AS prompt
FROM batched GROUP BY batch_id""")
def _prompt_batches(spark, sf):
    return C.prompt_batches(_numbered(spark, sf))


@register("apply_replies", _NUMBERED + f"""
SELECT pos, batch_id, batch_pos, CASE
    WHEN batch_id % 9 >= 3 THEN {category_sql('section_title')}
    WHEN batch_id % 9 = 1 AND batch_pos >= 2 THEN 'Other'
    ELSE 'Label ' || ((batch_id + batch_pos) % 7) END AS ai_category FROM batched""")
def _apply_replies(spark, sf):
    """Replies in full, too short, fenced and too long; broken, not an array, missing, with
    other quotes, with another key behind the array, and with a comma too many."""
    numbered = C.with_batch(_numbered(spark, sf))
    batch, kind = F.col("batch_id"), F.col("batch_id") % 9
    size = F.when(kind == 1, 2).when(kind == 2, 25).otherwise(20)
    labels = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.concat(F.lit('"Label '), ((batch + i) % 7).cast("string"), F.lit('"')),
    )
    array = F.concat(F.lit("["), F.array_join(labels, ", "), F.lit("]"))
    reply = (
        F.when(kind == 2, F.concat(F.lit("```json\n"), array, F.lit("\n```\nDone.")))
        .when(kind == 3, F.concat(array, F.lit(" as you asked")))
        .when(kind == 4, F.concat(F.lit('{"labels": '), array, F.lit("}")))
        .when(kind == 6, F.translate(array, '"', "'"))
        .when(kind == 7, F.concat(array, F.lit(', "labels": ["Z"]')))
        .when(kind == 8, F.concat(F.lit("["), F.array_join(labels, ", "), F.lit(",]")))
        .otherwise(array)
    )
    replies = numbered.select("batch_id").distinct().where(kind != 5)
    applied = C.apply_replies(
        numbered.drop("batch_id", "batch_pos"), replies.select("batch_id", reply.alias("reply"))
    )
    return C.with_batch(applied).select("pos", "batch_id", "batch_pos", "ai_category")


_TOPICS = ("Prose & verse", "Lists", "Other")


@register("prompt_categories", _NUMBERED + f"""
SELECT batch_id, count(*) AS n_sections,
  'Categorize each of the following website sections into one of these categories:' || chr(10)
  || chr(10) || {" || chr(10) || ".join(quoted('- ' + c) for c in _TOPICS)} || chr(10) || chr(10)
  || 'Sections to categorize:' || chr(10)
  || string_agg((batch_pos + 1) || '. Title: "' || section_title || '" | Content preview: "'
       || content[1:200] || '..."', chr(10) ORDER BY batch_pos) AS head
FROM batched GROUP BY batch_id""")
def _prompt_categories(spark, sf):
    prompts = C.prompt_batches(_numbered(spark, sf), _TOPICS)
    head = F.substring_index("prompt", "\n\nRespond with a JSON array", 1)
    return prompts.select("batch_id", "n_sections", head.alias("head"))


# --- reports --------------------------------------------------------------------------


@register("category_summary", Q.with_(DOC_SECTIONS) + """
SELECT url, ai_category AS category, count(section_title) AS section_count,
  sum(length(content))::BIGINT AS total_content_length FROM doc_sections GROUP BY ALL""")
def _category_summary(spark, sf):
    return R.category_summary(doc_sections(spark, sf))


_ALIVE = Q.with_(DOC_SECTIONS, Q.cleaned("doc_sections"), Q.filtered("cleaned"))


@register("filter_summary", _ALIVE + """
SELECT a AS original_rows, b AS filtered_rows, a - b AS removed_rows,
  round_even(((a - b)::DOUBLE / a::DOUBLE) * 100, 1)::DOUBLE AS removal_percentage
FROM (SELECT (SELECT count(*) FROM doc_sections) AS a, (SELECT count(*) FROM kept) AS b)""")
def _filter_summary(spark, sf):
    ds = doc_sections(spark, sf)
    return R.filter_summary(ds, FL.filter_sections(ds, order_by=["pos"]))


@register("category_counts", Q.with_(DOC_SECTIONS) + """
SELECT ai_category, count(*) AS n_sections FROM doc_sections GROUP BY ALL""")
def _category_counts(spark, sf):
    return R.category_counts(doc_sections(spark, sf))


@register("run_totals", _ALIVE + """
SELECT u AS n_urls, a AS n_sections, b AS n_kept,
  round_even((1 - b::DOUBLE / a::DOUBLE) * 100, 0)::BIGINT AS noise_percentage
FROM (SELECT (SELECT count(DISTINCT url) FROM doc_sections) AS u,
             (SELECT count(*) FROM doc_sections) AS a, (SELECT count(*) FROM kept) AS b)""")
def _run_totals(spark, sf):
    ds = doc_sections(spark, sf)
    kept = FL.filter_sections(ds, order_by=["pos"])
    return R.run_totals(ds.select("url").distinct(), ds, kept)


def _width(column: str) -> str:
    cap = R.WIDE_CAP if column in R.WIDE_COLUMNS else R.CAP
    return (
        f"SELECT {quoted(column)} AS column_name, (least(greatest((SELECT "
        f"max(length({column}::VARCHAR)) FROM doc_sections), {len(column)}), {cap}) + 2)::INT AS width"
    )


@register("column_widths", Q.with_(DOC_SECTIONS) + " UNION ALL ".join(
    _width(c) for c in _ROWS.split(", ")))
def _column_widths(spark, sf):
    return R.column_widths(doc_sections(spark, sf))


# --- order and outputs ----------------------------------------------------------------


@register("row_numbers", _NUMBERED + f" SELECT row_no, {_ROWS} FROM numbered")
def _row_numbers(spark, sf):
    return _numbered(spark, sf)


@register("page_breaks", _NUMBERED + """
SELECT row_no, url, pos, coalesce(lag(url) OVER (ORDER BY row_no) <> url, false) AS is_break
FROM numbered""")
def _page_breaks(spark, sf):
    return N.mark_page_breaks(_numbered(spark, sf)).select("row_no", "url", "pos", "is_break")


@register("csv_roundtrip", _NUMBERED + f"""
SELECT row_no, url, pos, section_title, section_level,
  {Q.strip("replace(content, chr(10), ' | ')")} AS content, ai_category FROM numbered""")
def _csv_roundtrip(spark, sf):
    path = new_folder(spark, "csv")
    O.write_csv(O.export_table(doc_sections(spark, sf), ["pos"]), path)
    schema = (
        "row_no bigint, url string, pos bigint, section_title string, section_level string, "
        "content string, ai_category string"
    )
    return O.read_csv(spark, path, schema)


@register("summary_side_output", Q.with_(DOC_SECTIONS, """
summed AS (SELECT url, ai_category AS category, count(section_title) AS section_count,
  sum(length(content))::BIGINT AS total_content_length FROM doc_sections GROUP BY ALL)""") + """
SELECT row_number() OVER (ORDER BY url, category) AS row_no, * FROM summed""")
def _summary_side_output(spark, sf):
    path = new_folder(spark, "report") + "/sections.csv"
    O.write_report(doc_sections(spark, sf), path, ["pos"], summary=True)
    schema = (
        "row_no bigint, url string, category string, section_count bigint, "
        "total_content_length bigint"
    )
    return O.read_csv(spark, O.summary_path(path), schema)


@register("parquet_roundtrip", Q.with_(DOC_SECTIONS, """
chosen AS (SELECT url, min(pos) AS pos FROM doc_sections GROUP BY url)""") + """
SELECT pos, url, section_title, section_level, content, ai_category FROM doc_sections
WHERE pos IN (SELECT pos FROM chosen) OR url = (SELECT max(url) FROM doc_sections)""")
def _parquet_roundtrip(spark, sf):
    path = new_folder(spark, "report") + "/sections.parquet"
    O.write_parquet(doc_sections(spark, sf), path, ["pos"])
    back = spark.read.parquet(path)
    chosen = back.groupBy("url").agg(F.min("pos").alias("pos"))
    last = back.agg(F.max("url")).first()[0]
    by_place = back.join(chosen.select("pos"), "pos", "left_semi")
    return by_place.unionByName(back.where(F.col("url") == last)).distinct().select(
        "pos", "url", "section_title", "section_level", "content", "ai_category"
    )


@register("shape_sections", Q.with_(DOC_SECTIONS) + """
SELECT url, CASE WHEN pos % 2 = 0 THEN section_title ELSE '' END AS page_title, '' AS description,
  '' AS canonical_url, section_title, section_level, content,
  CASE WHEN pos % 3 = 0 THEN '' ELSE ai_category END AS ai_category FROM doc_sections""")
def _shape_sections(spark, sf):
    ds = doc_sections(spark, sf).withColumns(
        {
            "page_title": F.when(F.col("pos") % 2 == 0, F.col("section_title")),
            "ai_category": F.when(F.col("pos") % 3 != 0, F.col("ai_category")),
        }
    )
    return E.shape_sections(ds)


# --- URL lists ------------------------------------------------------------------------

_URLS = f"""
urls AS (SELECT row_id AS url_no, {Q.strip('"Website"')} AS url FROM listed_urls
         WHERE "Website" IS NOT NULL AND {Q.strip('"Website"')} <> '')"""
_NORMAL = "CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://' || url END"
_HOST = f"regexp_extract(regexp_extract({_NORMAL}, '^https?://([^/?#]*)', 1), '^[^:]*')"
_LABELS = f"string_split({_HOST}, '.')"
_VALID = f"""(len({_LABELS}) >= 2 AND regexp_full_match({_LABELS}[-1], '[a-zA-Z][a-zA-Z]+')
  AND list_bool_and(list_transform({_LABELS}, lambda x: regexp_full_match(x, '[a-zA-Z0-9-]+')
    AND NOT starts_with(x, '-') AND NOT ends_with(x, '-'))))"""


def _urls(spark, sf) -> DataFrame:
    return SU.url_list(listed_urls(spark, sf), "row_id")


@register("url_csv_scan", Q.with_(LISTED_URLS, _URLS) + """
SELECT u.url_no, u.url, l."Site Name" AS site, l."Rank"::INT AS rank
FROM urls u JOIN listed_urls l ON l.row_id = u.url_no""")
def _url_csv_scan(spark, sf):
    path = new_folder(spark, "urls")
    O.write_csv(listed_urls(spark, sf).withColumnRenamed("row_id", "No"), path, sort_by="No")
    scanned = SU.read_url_csv(spark, path).drop("row_id")
    urls = SU.url_list(scanned, "No", wanted="WEBSITE")
    rows = scanned.select("No", F.col("Site Name").alias("site"), F.col("Rank").alias("rank"))
    return urls.join(rows, urls["url_no"] == rows["No"]).drop("No")


@register("url_csv_files", Q.with_(LISTED_URLS, """
ordered AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN row_id % 9 = 0 THEN 0
    WHEN row_id % 9 < 7 THEN 1 ELSE 2 END, row_id) AS url_no FROM listed_urls)""", f"""
tidy AS (SELECT url_no, {Q.strip('"Website"')} AS url, "Rank"::INT AS rank FROM ordered
         WHERE {Q.strip('"Website"')} <> '')""") + """
SELECT url_no, url, last_value(rank) OVER (PARTITION BY url ORDER BY url_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS source_rank FROM tidy""")
def _url_csv_files(spark, sf):
    """Files of unequal sizes, the largest one in the middle; the scan's own order counts."""
    folder, rest = new_folder(spark, "urls"), F.col("row_id") % 9
    rows = listed_urls(spark, sf)
    for i, own in enumerate((rest == 0, (rest > 0) & (rest < 7), rest >= 7)):
        one = rows.where(own).repartition(1).sortWithinPartitions("row_id").drop("row_id")
        O.write_csv(one, f"{folder}/{i}")
    scanned = SU.read_url_csv(spark, f"{folder}/*")
    meta = SU.url_metadata(scanned, "row_id", "Website").select("url", "source_rank")
    return SU.url_list(scanned, "row_id", "Website").join(meta, "url", "left").select(
        "url_no", "url", "source_rank"
    )


@register("url_csv_line_feeds", """
SELECT row_number() OVER (ORDER BY doc_id) AS row_id, 'https://' || source || '/' || doc_id AS url,
  nullif(text, '') AS text, n_chars FROM documents""")
def _url_csv_line_feeds(spark, sf):
    """Whole texts as cells: quotes, commas and line feeds in every block of the files."""
    path, docs = new_folder(spark, "urls"), table(spark, sf, "documents")
    url = F.concat(F.lit("https://"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    O.write_csv(docs.select("doc_id", url.alias("url"), "text", "n_chars"), path, sort_by="doc_id")
    scanned = SU.read_url_csv(spark, path, multiline=True)
    return scanned.select("row_id", "url", "text", F.col("n_chars").cast("long").alias("n_chars"))


@register("url_column_resolve", Q.with_(LISTED_URLS) + """
SELECT row_id AS url_no, trim("Site Name") AS first_column, "Website" AS website
FROM listed_urls WHERE "Website" IS NOT NULL AND trim("Website") <> ''""")
def _url_column_resolve(spark, sf):
    urls = listed_urls(spark, sf).where("trim(Website) <> ''")
    named = SU.resolve_url_column(urls.columns, "Link")  # falls through to Website
    first = SU.resolve_url_column([c for c in urls.columns if c not in (named, "row_id")])
    return urls.select(
        F.col("row_id").alias("url_no"), F.col(f"`{first}`").alias("first_column"),
        F.col(named).alias("website"),
    )


@register("url_clean", Q.with_(LISTED_URLS, _URLS) + " SELECT * FROM urls")
def _url_clean(spark, sf):
    return _urls(spark, sf)


@register("url_metadata_last", Q.with_(LISTED_URLS, f"""
tidy AS (SELECT row_id, {Q.strip('"Website"')} AS url, "Site Name", "Rank" FROM listed_urls)""") + """
SELECT url, arg_max("Site Name", row_id) AS source_site_name, max_by("Rank", row_id) AS source_rank
FROM tidy WHERE url <> '' GROUP BY url""")
def _url_metadata_last(spark, sf):
    return SU.url_metadata(listed_urls(spark, sf), "row_id")


@register("url_text_lines", f"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  (unnest(range(len(string_split(text, chr(10))))))::INT AS line_no FROM documents)
SELECT doc_id, line_no, {Q.strip('line')} AS url FROM lines WHERE {Q.strip('line')} <> ''""")
def _url_text_lines(spark, sf):
    return SU.urls_from_text(table(spark, sf, "documents"), "text", "doc_id")


@register("url_validate", Q.with_(LISTED_URLS, _URLS) + f"""
SELECT url_no, url, {_VALID} AS is_valid FROM urls""")
def _url_validate(spark, sf):
    return _urls(spark, sf).withColumn("is_valid", U.is_valid_url("url"))


@register("url_normalize", Q.with_(LISTED_URLS, _URLS) + f"""
SELECT url_no, url, {_NORMAL} AS target FROM urls""")
def _url_normalize(spark, sf):
    return _urls(spark, sf).withColumn("target", U.normalize_url("url"))


@register("url_route_counts", Q.with_(LISTED_URLS, _URLS) + f"""
SELECT {_VALID} AS is_valid, count(*) AS n_urls FROM urls GROUP BY ALL""")
def _url_route_counts(spark, sf):
    return SU.route_counts(_urls(spark, sf))


_META_LAST = """
url_meta AS (SELECT url, arg_max("Site Name", row_id) AS source_site_name,
  max_by("Rank", row_id) AS source_rank FROM (
    SELECT row_id, {strip} AS url, "Site Name", "Rank" FROM listed_urls) WHERE url <> ''
  GROUP BY url)""".replace("{strip}", Q.strip('"Website"'))


@register("join_source_metadata", Q.with_(LISTED_URLS, _META_LAST) + """
SELECT p.page_id, p.url, m.source_site_name, m.source_rank
FROM pages p LEFT JOIN url_meta m ON m.url = p.url""")
def _join_source_metadata(spark, sf):
    metadata = SU.url_metadata(listed_urls(spark, sf), "row_id")
    pages = table(spark, sf, "pages").select("page_id", "url")
    joined = E.add_source_columns(pages, metadata)
    return joined.select("page_id", "url", "source_site_name", "source_rank")


_LISTED = f"""
known AS (SELECT CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://' || url END
            AS target, min(page_id) AS page_id FROM pages GROUP BY ALL),
listed AS (SELECT u.url_no, u.url, k.page_id
           FROM (SELECT *, {_NORMAL} AS target FROM urls) u LEFT JOIN known k USING (target))"""


@register("pages_for_urls", Q.with_(LISTED_URLS, _URLS, _LISTED) + " SELECT * FROM listed")
def _pages_for_urls(spark, sf):
    return P.pages_for_urls(_urls(spark, sf), table(spark, sf, "pages"))


# --- extraction -----------------------------------------------------------------------

_TOKENS = Q.with_(LAYOUT_PAGES, Q.tokens())
_SECTIONS = Q.with_(LAYOUT_PAGES, Q.tokens(), Q.sections())
_SECTION = "page_id, sec_no, section_title, section_level, content, content_source"


def _meta_query(column: str) -> None:
    def run(spark, sf):
        return S.page_meta(layout_pages(spark, sf), [column]).select("page_id", column)

    name = "meta_description" if column == "description" else column
    register(name, Q.with_(LAYOUT_PAGES, Q.tokens(), Q.META) + f"""
SELECT page_id, {column} FROM page_meta""")(run)


for _column in ("page_title", "description", "canonical_url"):
    _meta_query(_column)


@register("strip_elements", Q.with_(LAYOUT_PAGES) + f"""
SELECT page_id, regexp_replace(html, '{Q.GONE}', '<!>', 'g') AS html FROM layout_pages""")
def _strip_elements(spark, sf):
    return layout_pages(spark, sf).select("page_id", strip_elements("html").alias("html"))


@register("headings", _TOKENS + """
SELECT page_id, head_no::INT AS head_no, tag AS section_level, depth::INT AS depth FROM heads""")
def _headings(spark, sf):
    found = S.page_headings(layout_pages(spark, sf))
    return found.select("page_id", "head_no", "section_level", "depth")


@register("heading_boundaries", _TOKENS + """
SELECT h.page_id, h.head_no::INT AS head_no, n.head_no::INT AS next_no
FROM heads h LEFT JOIN heads n ON n.page_id = h.page_id AND n.pos = h.boundary""")
def _heading_boundaries(spark, sf):
    found = S.page_headings(layout_pages(spark, sf))
    return found.select("page_id", "head_no", "next_no")


@register("heading_titles", _TOKENS + """
SELECT h.page_id, h.head_no::INT AS head_no, coalesce(title, '') AS title
FROM heads h LEFT JOIN titles t ON t.page_id = h.page_id AND t.pos = h.pos""")
def _heading_titles(spark, sf):
    return S.page_headings(layout_pages(spark, sf)).select("page_id", "head_no", "title")


def _sections_from(name: str, *sources: str) -> None:
    def run(spark, sf):
        found = S.extract_sections(layout_pages(spark, sf))
        return found.where(F.col("content_source").isin(*sources)).select(*_SECTION.split(", "))

    register(name, _SECTIONS + f"""
SELECT {_SECTION} FROM sections WHERE {Q.is_in('content_source', sources)}""")(run)


_sections_from("sections", S.SIBLINGS)
_sections_from("sections_grid", S.PARENT, S.GRANDPARENT)
_sections_from("sections_docorder", S.ORDER)
_sections_from("main_content", "main")



@register("sections_stored", _SECTIONS + f" SELECT {_SECTION} FROM sections")
def _sections_stored(spark, sf):
    """All sections from a table of parsed pages in buckets."""
    path = new_folder(spark, "page-store")
    pages = P.store_pages(layout_pages(spark, sf), "pagesift_" + path[-32:], 8, path)
    return S.extract_sections(pages).select(*_SECTION.split(", "))


_HOLDERS = "|".join(S.HOLDER_CLASSES)


@register("sections_container", _TOKENS + f""",
boxes AS (
  SELECT o.page_id, o.pos, o.depth, coalesce((SELECT min(s.pos) FROM steps s
      WHERE s.page_id = o.page_id AND s.pos > o.pos AND s.low < o.depth), 1000000000) AS box_end
  FROM steps o WHERE o.tag IN ('section', 'article', 'div') AND o.opens = 1
    AND regexp_matches(coalesce({Q.attribute('o.t', 'class')}, ''), '(?i){_HOLDERS}')),
chosen AS (
  SELECT h.page_id, h.pos, t.title, max_by(struct_pack(a := b.pos, z := b.box_end), b.depth) AS box
  FROM heads h JOIN titles t USING (page_id, pos)
  JOIN boxes b ON b.page_id = h.page_id AND b.pos < h.pos AND b.box_end > h.pos
    AND b.depth > h.depth - 5 GROUP BY ALL),
whole AS (
  SELECT c.page_id, c.pos, c.title, string_agg(s.text, ' ' ORDER BY s.pos) AS content
  FROM chosen c JOIN steps s ON s.page_id = c.page_id AND s.pos > c.box.a AND s.pos < c.box.z
  WHERE s.text <> '' GROUP BY ALL)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos))::INT AS box_no,
  title AS section_title, (CASE WHEN starts_with(content, title)
    THEN {Q.strip('content[length(title) + 1:]')} ELSE content END)[1:5000] AS content FROM whole""")
def _sections_container(spark, sf):
    return S.container_sections(layout_pages(spark, sf))


@register("content_cap", Q.with_(LAYOUT_PAGES, Q.tokens(), Q.sections(700)) + """
SELECT page_id, sec_no, content, length(content)::INT AS n FROM sections""")
def _content_cap(spark, sf):
    found = S.extract_sections(layout_pages(spark, sf), max_content=700)
    return found.select("page_id", "sec_no", "content", F.length("content").alias("n"))




def _listed_sections_sql(urls: str) -> str:
    return Q.with_(
        LAYOUT_PAGES, Q.tokens(), Q.sections(), Q.META, LISTED_URLS, urls, _LISTED, """
listed_sections AS (
  SELECT l.url_no, coalesce(s.sec_no, 1) AS sec_no, l.url,
    CASE WHEN s.page_id IS NULL OR s.content_source = 'none' THEN '' ELSE m.page_title END
      AS page_title,
    CASE WHEN s.page_id IS NULL OR s.content_source = 'none' THEN '' ELSE m.description END
      AS description,
    CASE WHEN s.page_id IS NULL OR s.content_source = 'none' THEN '' ELSE m.canonical_url END
      AS canonical_url,
    coalesce(s.section_title, 'ERROR') AS section_title,
    coalesce(s.section_level, 'error') AS section_level,
    coalesce(s.content, 'Failed to fetch page') AS content
  FROM listed l LEFT JOIN sections s USING (page_id) LEFT JOIN page_meta m USING (page_id))""")


_LISTED_SECTIONS = _listed_sections_sql(_URLS)


@register("section_order", _LISTED_SECTIONS + """
SELECT url_no, sec_no, url, page_title, description, canonical_url, section_title, section_level,
  content, row_number() OVER (ORDER BY url_no, sec_no) AS row_no FROM listed_sections""")
def _section_order(spark, sf):
    found = listed_sections(_urls(spark, sf), layout_pages(spark, sf))
    return N.with_row_number(stage(found, "sections"), ["url_no", "sec_no"])


@register("sentinel_rows", _LISTED_SECTIONS + """
SELECT url_no, url, section_title, section_level, content FROM listed_sections
WHERE section_level IN ('error', 'none')""")
def _sentinel_rows(spark, sf):
    found = listed_sections(_urls(spark, sf), layout_pages(spark, sf))
    return found.where(F.col("section_level").isin("error", "none")).select(
        "url_no", "url", "section_title", "section_level", "content"
    )


@register("pages_to_report", _LISTED_SECTIONS + "," + _META_LAST + "," + ",".join((f"""
shaped AS (SELECT s.*, m.source_site_name, m.source_rank,
    {category_sql('section_title')} AS ai_category
  FROM listed_sections s LEFT JOIN url_meta m USING (url))""",
    Q.cleaned("shaped"), Q.filtered("cleaned", "url_no, sec_no"))) + """
SELECT url_no, sec_no, url, source_site_name, source_rank, page_title, description, canonical_url,
  section_title, section_level, content, ai_category FROM kept""")
def _pages_to_report(spark, sf):
    listed = listed_urls(spark, sf)
    return site_report(
        SU.url_list(listed, "row_id"), layout_pages(spark, sf), SU.url_metadata(listed, "row_id")
    )


_PICKED = " ".join(f"WHEN {i} THEN {quoted(c)}" for i, c in enumerate(C.CATEGORIES))


@register("replies_to_report", _LISTED_SECTIONS + "," + ",".join((f"""
numbered AS (SELECT *, row_number() OVER (ORDER BY url_no, sec_no) - 1 AS i FROM listed_sections),
shaped AS (SELECT * EXCLUDE (i), CASE WHEN i // 20 % 3 = 1
    THEN CASE (i // 20 + i % 20) % {len(C.CATEGORIES)} {_PICKED} END
    ELSE {category_sql('section_title')} END AS ai_category FROM numbered)""",
    Q.cleaned("shaped"), Q.filtered("cleaned", "url_no, sec_no"))) + """
SELECT url_no, sec_no, url, page_title, description, canonical_url, section_title, section_level,
  content, ai_category FROM kept""")
def _replies_to_report(spark, sf):
    """Every third batch is answered, every third with something unreadable, the rest not."""
    urls, pages = _urls(spark, sf), layout_pages(spark, sf)
    batch = F.col("batch_id")
    names = F.array(*[F.lit(c) for c in C.CATEGORIES])
    labels = F.transform(
        F.sequence(F.lit(0), F.lit(19)),
        lambda k: F.get(names, ((batch + k) % len(C.CATEGORIES)).cast("int")),
    )
    reply = F.when(batch % 3 == 1, F.to_json(labels)).otherwise("Sorry: ['Other']")
    prompts = report_prompts(urls, pages).where(batch % 3 > 0)
    return site_report(urls, pages, replies=prompts.select("batch_id", reply.alias("reply")))


_SUBMITTED = "raw_" + _URLS.strip() + f""",
urls AS (SELECT n AS url_no, {_NORMAL} AS url FROM (
    SELECT url, row_number() OVER (ORDER BY url_no) AS n FROM raw_urls) WHERE {_VALID})"""


def _typed(spark, sf) -> DataFrame:
    """The URL table as texts of thirty rows each, one URL per line."""
    rows = listed_urls(spark, sf).where(F.col("Website").isNotNull())
    grouped = rows.groupBy(F.floor(F.col("row_id") / 30).alias("text_id")).agg(
        F.sort_array(F.collect_list(F.struct("row_id", "Website"))).alias("lines")
    )
    text = F.array_join(F.transform("lines", lambda x: x["Website"]), "\n")
    return grouped.select("text_id", text.alias("text"))


@register("url_submitted", Q.with_(LISTED_URLS, _SUBMITTED) + " SELECT * FROM urls")
def _url_submitted(spark, sf):
    return SU.submitted_urls(_typed(spark, sf), "text", "text_id")


@register("text_to_report", _listed_sections_sql(_SUBMITTED) + "," + ",".join((f"""
shaped AS (SELECT *, {category_sql('section_title')} AS ai_category FROM listed_sections)""",
    Q.cleaned("shaped"), Q.filtered("cleaned", "url_no, sec_no"))) + """
SELECT url_no, sec_no, url, page_title, description, canonical_url, section_title, section_level,
  content, ai_category FROM kept""")
def _text_to_report(spark, sf):
    return submitted_report(_typed(spark, sf), "text", "text_id", layout_pages(spark, sf))
