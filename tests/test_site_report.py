

from pagesift.operators.reports import column_widths
from pagesift.operators.sections import page_meta
from pagesift.plans.site_report import listed_sections, site_report
from pagesift.sources.outputs import write_report
from pagesift.sources.rules import FALLBACK_RULES
from pagesift.sources.urls import read_url_csv, url_metadata


def inputs(spark, as_table):
    text = " ".join(["some words that say a thing"] * 3)
    html = f"<title>T</title><h1>About us</h1><p>{text}</p><h2>Our products</h2><p>{text} two</p>"
    pages = as_table(spark.createDataFrame(
        [(1, "https://a.com", html), (2, "http://b.com/x", ""), (3, "https://c.com", "<p></p>")],
        "page_id long, url string, html string"), "pages")
    listed = ["a.com", "b.com", "http://b.com/x", " c.com", "a.com"]
    urls = as_table(spark.createDataFrame(
        [(i, u.strip()) for i, u in enumerate(listed)], "url_no long, url string"), "urls")
    return urls, pages


def test_every_listed_url_gives_rows(spark, as_table):
    urls, pages = inputs(spark, as_table)
    rows = listed_sections(urls, pages).collect()
    got = sorted((r.url_no, r.sec_no, r.url, r.section_title) for r in rows)
    assert got == [
        (0, 1, "a.com", "About us"), (0, 2, "a.com", "Our products"),
        (1, 1, "b.com", "ERROR"), (2, 1, "http://b.com/x", "ERROR"),
        (3, 1, "c.com", "NO_CONTENT"),
        (4, 1, "a.com", "About us"), (4, 2, "a.com", "Our products"),
    ]


def test_report(spark, as_table):
    urls, pages = inputs(spark, as_table)
    meta = spark.createDataFrame([("a.com", 7)], "url string, source_rank int")
    rows = site_report(urls, pages, meta).collect()
    # the second listing repeats the first, sentinel rows are too short or uncategorised
    assert sorted((r.url_no, r.section_title, r.ai_category, r.source_rank) for r in rows) == [
        (0, "About us", "About/Company Overview", 7), (0, "Our products", "Products/Services", 7)]
    plain = site_report(urls, pages, rules=FALLBACK_RULES, keywords=None).collect()
    # five words, and no category to exclude
    assert ("c.com", "NO_CONTENT", "") in [(r.url, r.section_title, r.ai_category) for r in plain]
    assert site_report(urls, pages, rules=None).count() == 7


def test_any_column_name_goes_through(spark, as_table, tmp_path):
    urls, pages = inputs(spark, as_table)
    (tmp_path / "u.csv").write_text('"No. of (x), `y`",Url\n5,a.com\n')
    scanned = read_url_csv(spark, str(tmp_path / "u.csv"))
    report = site_report(urls, pages, url_metadata(scanned, "row_id"))
    path = str(tmp_path / "out.csv")
    write_report(report, path, ["url_no", "sec_no"], drop=("url_no", "sec_no"))
    lines = spark.read.csv(path, header=True)
    assert lines.columns[:3] == ["row_no", "url", "source_no._of_(x),_`y`"]
    assert sorted(tuple(r)[:3] for r in lines.collect()) == [("1", "a.com", "5"), ("2", "a.com", "5")]
    assert column_widths(report).count() == len(report.columns)


def test_ids_are_joined_below_every_regex(spark, as_table):
    urls, pages = inputs(spark, as_table)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = listed_sections(urls, pages)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("regexp_replace(html") < plan.index("Join LeftSemi")  # the tree is upside down


def test_titles_are_read_where_pages_lie(spark, as_table):
    _, pages = inputs(spark, as_table)
    plan = page_meta(pages, ["page_title"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "canonical" not in plan and "meta|link" not in plan
