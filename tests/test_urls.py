from pagesift.functions.urls import is_valid_url, normalize_url
from pagesift.sources import urls as U
from pagesift.sources.pages import pages_for_urls


def test_is_valid_url(values):
    cases = {
        "example.com": True, " https://a.b-c.org/x?y#z ": True, "http://x.com:8080": True,
        "exam\nple.com": True, "sub.example.co.uk": True, "EXAMPLE.COM": True,
        "": False, "   ": False, None: False, "localhost": False, "1.2.3.4": False,
        "user@x.com": False, "http://": False, "-a.com": False, "a-.com": False, "a..com": False,
        "a.c": False, "a.c1": False, "HTTP://x.com": False, "ftp://x.com": False,
        "x.com.": False, "ex ample.com": False, "https://é.com": False,
    }
    assert values(is_valid_url, cases) == list(cases.values())


def test_normalize_url(values):
    assert values(normalize_url, [" x.com ", "http://x", "HTTP://x", " https://y\n"]) == [
        "https://x.com", "http://x", "https://HTTP://x", "https://y"
    ]


def test_resolve_url_column():
    assert U.resolve_url_column(["a", "URL"]) == "URL"
    assert U.resolve_url_column(["Link", "Site"], "site") == "Site"
    assert U.resolve_url_column(["website", "LINK"]) == "LINK"
    assert U.resolve_url_column(["x", "y"]) == "x"
    assert U.resolve_url_column(["url", "Url"]) == "Url"


def test_url_csv(spark, tmp_path):
    (tmp_path / "u.csv").write_text(
        'Name,Link,Year\n"A, ""x""", a.com ,2001\nB,,2002\nC,NaN,2003\nD,a.com,2004\n'
    )
    scanned = U.read_url_csv(spark, str(tmp_path / "u.csv"))
    assert dict(scanned.dtypes)["Year"] == "int"
    urls = U.url_list(scanned, "row_id").collect()
    assert [(r.url_no, r.url) for r in urls] == [(1, "a.com"), (4, "a.com")]
    meta = U.url_metadata(scanned, "row_id").collect()
    assert [(r.url, r.source_name, r.source_year) for r in meta] == [("a.com", "D", 2004)]


def test_urls_from_text_and_routes(spark):
    texts = spark.createDataFrame([(1, "a.com\n\n b.org \nnope")], "id long, text string")
    urls = U.urls_from_text(texts, "text", "id")
    assert [(r.line_no, r.url) for r in urls.collect()] == [(0, "a.com"), (2, "b.org"), (3, "nope")]
    routed = {r.url: r.target for r in U.route_urls(urls).collect()}
    assert routed == {"a.com": "https://a.com", "b.org": "https://b.org", "nope": None}
    assert {r.is_valid: r.n_urls for r in U.route_counts(urls).collect()} == {True: 2, False: 1}


def test_pages_for_urls_keeps_repeats_and_raw_urls(spark, as_table):
    urls = as_table(spark.createDataFrame(
        [(i, u) for i, u in enumerate(["a.com", "https://a.com", "b.com", "http://a.com"] * 5)],
        "url_no long, url string"))
    pages = spark.createDataFrame(
        [(7, "https://a.com", "x"), (5, "a.com", "y"), (9, "http://a.com", "z")],
        "page_id long, url string, html string")
    want = [(i, u, {"a.com": 5, "https://a.com": 5, "http://a.com": 9}.get(u))
            for i, u in enumerate(["a.com", "https://a.com", "b.com", "http://a.com"] * 5)]
    got = pages_for_urls(urls, pages).collect()
    assert sorted((r.url_no, r.url, r.page_id) for r in got) == want


def test_submitted_urls(spark):
    texts = spark.createDataFrame([(2, "x.org"), (1, " a.com \nlocalhost\n\nhttp://b.org/y")],
                                  "id long, text string")
    got = U.submitted_urls(texts, "text", "id").orderBy("url_no").collect()
    assert [(r.url_no, r.url) for r in got] == [
        (1, "https://a.com"), (3, "http://b.org/y"), (4, "https://x.org")]


def test_metadata_column_names(spark):
    table = spark.createDataFrame([(1, "u", 1, 2)], "row_id int, url string, `a b` int, `A_B` int")
    assert U.url_metadata(table, "row_id").collect()[0].asDict() == {"url": "u", "source_a_b": 2}
    assert U.url_metadata(table.select("row_id", "url"), "row_id").columns == ["url"]
