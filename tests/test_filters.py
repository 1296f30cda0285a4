import re

from pagesift.operators import dedup as D
from pagesift.operators import filters as FL
from pagesift.sources.rules import DEFAULT_RULES, rules_of

SCHEMA = (
    "url_no long, sec_no int, url string, section_title string, section_level string, "
    "content string, ai_category string"
)
LONG = "five words are in here"


def rows(spark, *cells):
    """(title, content[, category]) per row, all of one URL."""
    data = [
        (0, i, "https://a.com", c[0], "h2", c[1], c[2] if len(c) > 2 else "Products/Services")
        for i, c in enumerate(cells)
    ]
    return spark.createDataFrame(data, SCHEMA)


def kept(df, *steps, rules=DEFAULT_RULES):
    return sorted(r.sec_no for r in FL.keep_rows(df, rules, steps).collect())


def test_category(spark):
    df = rows(spark, ("t", LONG, "Other"), ("t", LONG, None), ("t", LONG, "other"), ("t", LONG, ""))
    assert kept(df, "category") == [1, 2, 3]
    assert kept(df.drop("ai_category"), "category") == [0, 1, 2, 3]


def test_keywords(spark):
    df = rows(spark, ("t", "All RIGHTS reserved"), ("Newsletter", "x"), ("terms", "and conditions"),
              ("t", "allrights reserved"), ("t", "x"))
    assert kept(df, "keyword") == [3, 4]
    upper = rules_of({"boilerplate_keywords": ["Secret"]})  # matched as written, never hits
    assert kept(rows(spark, ("t", "Secret")), "keyword", rules=upper) == [0]


def test_titles(spark):
    df = rows(spark, (" RELATED Products ", "x"), ("Our sitemap here", "x"), ("", "footer"), ("t", "x"))
    assert kept(df, "title") == [2, 3]


def test_product_links(spark):
    df = rows(
        spark,
        ("Disc X", "disc x"), ("Disc X", "Disc X Best"), ("Disc X", "goodDisc Xnew"),
        ("Disc X", "The disc x is round"), ("Disc X", "disc x abcde"), ("Disc X", "disc x abcd"),
        ("", "x"), ("x", ""), ("New", "new"), ("Best one", "good best one better"),
    )
    # 4: content twice as long as the title; 8: contained and short; 9: "best" goes, too
    assert kept(df, "product_link") == [3, 4, 6, 7, 9]


def test_min_words(spark):
    df = rows(spark, ("t", "one two three four"), ("t", LONG), ("t", ""), ("t", "a  b\nc d&nbsp;e"),
              ("ERROR", "Failed to fetch page"), ("NO_CONTENT", "No sections found on page"))
    assert kept(df, "words") == [1, 3, 5]


def test_cleaning_leaves_phrases_in_titles(spark):
    df = rows(spark, ("<b>Read more</b>&nbsp;2", "Read more of this https://x.y"))
    (row,) = FL.clean_sections(df).collect()
    assert (row.section_title, row.content) == ("Read more 2", "of this")
    assert FL.clean_sections(df).columns == df.columns


def test_first_wins(spark):
    data = [(1, 0, "u", "a", "h2", "same", ""), (0, 5, "u", "b", "h3", "same", ""),
            (0, 1, "v", "c", "h2", "same", ""), (0, 2, "u", "d", "h2", "else", "")]
    df = spark.createDataFrame(data, SCHEMA)
    got = D.first_wins(df, ["url_no", "sec_no"]).collect()
    assert sorted(r.section_title for r in got) == ["b", "c", "d"]
    plan = D.first_wins(df, ["url_no", "sec_no"])._jdf.queryExecution().toString()
    assert re.search(r"WindowGroupLimit .*Partial", plan)  # copies are cut before the shuffle


def is_dump(h1, subs):
    """The rule, spelled out over plain lists."""
    held = [s for s in subs if len(s) > 50 and s[:100] in h1]
    return bool(h1) and len(subs) >= 3 and len(h1) > 0.8 * sum(map(len, subs)) and (
        2 * len(held) >= len(subs)
    )


def dump_cases():
    s51, s50 = "a" * 51, "b" * 50
    other = "c" * 60
    return {
        "two subs": (s51 * 3, [s51, s51 + "x"]),
        "three subs": (s51 + other + "d" * 60, [s51, other, "d" * 60]),
        "fifty is short": (s50 * 4, [s50, s50 + "", "x"]),
        "half of four": (s51 + other + "z" * 100, [s51, other, "q" * 30, "r" * 30]),
        "less than half": (s51 + "z" * 200, [s51, other, "q" * 30]),
        "too short": ("a" * 80, ["a" * 60, "a" * 70, "a" * 80]),
        "long prefix": ("p" * 100 + "y" * 300, ["p" * 150, "p" * 110, "k" * 20]),
        "empty": ("", [s51, other, "x" * 70]),
    }


def test_page_dumps(spark, as_table):
    data = []
    for n, (name, (h1, subs)) in enumerate(dump_cases().items()):
        data.append((n, 0, name, "Top", "h1", h1, ""))
        data.append((n, 90, name, "Top", "h1", "another first heading", ""))
        data.append((n, 91, name, "Top", "h2x", "another level", ""))
        data += [(n, i + 1, name, "Sub", f"h{2 + i % 5}", s, "") for i, s in enumerate(subs)]
    table = as_table(spark.createDataFrame(data, SCHEMA))
    want = {name for name, (h1, subs) in dump_cases().items() if is_dump(h1, subs)}
    assert want == {"three subs", "half of four", "long prefix"}
    found = D.page_dumps(table).collect()
    assert {r.url for r in found} == want and {r.sec_no for r in found} == {0}
    left = {(r.url, r.sec_no) for r in D.remove_page_dumps(table).collect()}
    # rows that share URL, title and level with a dump go with it
    assert left == {(r[2], r[1]) for r in data if not (r[2] in want and r[1] in (0, 90))}


def test_step_report_adds_up(spark):
    df = rows(
        spark, ("t", LONG, "Other"), ("t", "copyright " + LONG), ("footer", LONG), (LONG, LONG),
        ("t", "few"), ("t", LONG), ("u", LONG), ("v", LONG + " more"),
    )
    report = {r.step: r.n_rows for r in FL.step_report(df).collect()}
    assert report == {"category": 1, "keyword": 1, "title": 1, "product_link": 1, "words": 1,
                      "duplicate": 1, "page_dump": 0, "kept": 2}
    assert sum(report.values()) == df.count()
    once = FL.filter_sections(df)
    assert once.count() == 2
    assert FL.filter_sections(once).count() == 2


def test_cleaning_runs_once_per_row(spark):
    """A filter must not be pushed below the regexes and copy them."""
    df = rows(spark, ("t", LONG))
    plan = FL.keep_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    n_phrases = len(DEFAULT_RULES.boilerplate_phrases)
    assert plan.count("regexp_replace") < 2 * n_phrases + 12
