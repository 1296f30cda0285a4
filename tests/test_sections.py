from pagesift.operators import sections as S


def pages(spark, *html):
    return spark.createDataFrame(
        [(i, f"http://p{i}", h) for i, h in enumerate(html)],
        "page_id long, url string, html string",
    )


def found(spark, html, **options):
    got = S.extract_sections(pages(spark, html), **options).orderBy("sec_no").collect()
    return [(r.section_title, r.section_level, r.content, r.content_source) for r in got]


def test_siblings(spark):
    html = """<body><h1>A</h1><p>one <b>two</b> three</p><p>four</p><div><p>5</p><p>6</p></div>
      <h2>B</h2><ul><li>x</li><li>y</li></ul> tail<h1>C</h1><p>end</p></body>"""
    assert found(spark, html) == [
        ("A", "h1", "one | two | three four 5 | 6 B x | y tail", "siblings"),
        ("B", "h2", "x | y tail", "siblings"),
        ("C", "h1", "end", "siblings"),
    ]


def test_scope_ends_with_the_parent(spark):
    html = "<div><section><h2>A</h2><p>in</p></section><p>out</p></div>"
    assert found(spark, html) == [("A", "h2", "in", "siblings")]


def test_grid_and_row_grid(spark):
    html = """<div><div><h2>G</h2></div><div>side <p>more</p></div><p>last</p></div>
      <div><div><div><h2>R</h2></div></div><div>row</div></div>"""
    assert found(spark, html) == [
        ("G", "h2", "side | more last", "parent_siblings"),
        ("R", "h2", "row", "grandparent_siblings"),
    ]


def test_document_order_keeps_each_piece_once(spark):
    html = "<div><div><div><div><h2>D <i>d</i></h2></div></div></div></div><p>x</p><p>y</p><p>x</p>"
    assert found(spark, html) == [("Dd", "h2", "D d x y", "document_order")]
    assert found(spark, "<h2>Alone</h2>") == [("Alone", "h2", "Alone", "document_order")]


def test_empty_heading_ends_a_section(spark):
    html = "<h2>A</h2><p>a</p><h2> </h2><p>b</p><h3>C</h3><p>c</p>"
    assert found(spark, html) == [("A", "h2", "a", "siblings"), ("C", "h3", "c", "siblings")]


def test_repeated_headings_are_told_apart(spark):
    html = "<h2>A</h2><p>1</p><h2>A</h2><p>2</p>"
    assert [r[2] for r in found(spark, html)] == ["1", "2"]


def test_titles_and_entities(spark):
    html = "<h2>a &amp; <b> b </b>&lt;c&gt;</h2>x &eacute;&nbsp;&#8212;\n\n y"
    assert found(spark, html) == [("a &b<c>", "h2", "x é — y", "siblings")]


def test_unclosed_and_odd_markup(spark):
    html = """<h2>T<p>a<b>b<p title="x > y" data-z='<h1>no</h1>'>c 1 < 2</div></div><!-- <h2>no</h2>
      --><script>"<h2>no</h2>"</script><STYLE>h2{}</STYLE><noscript><h2>no</h2></noscript>d<h2"""
    assert found(spark, html) == [("T", "h2", "a | b c 1 < 2 | d", "siblings")]
    assert found(spark, "<h2>T</h2>d<!-- open <h2>x</h2>") == [("T", "h2", "d", "siblings")]
    assert found(spark, "<H2 class=x>T</H2 >d<hr>e") == [("T", "h2", "d e", "siblings")]


def test_no_heading(spark):
    html = "<title>t</title><body><nav>n</nav><article>a <p> b\n c</p><article>d</article>e</article>f"
    assert found(spark, html) == [("Main Content", "body", "a b\n c d e", "main")]
    assert found(spark, "<main>m</main><article>a</article>")[0][2] == "m"
    assert found(spark, "<title>t</title>x <b>y</b>")[0][2] == "x y"
    # an empty main element is still the one that counts
    assert found(spark, "<main></main><p>x</p>")[0][0] == "NO_CONTENT"


def test_pages_without_sections(spark):
    got = S.extract_sections(pages(spark, None, "", "<p><br></p>")).orderBy("page_id").collect()
    assert [(r.section_title, r.section_level, r.content, r.canonical_url) for r in got] == [
        ("ERROR", "error", "Failed to fetch page", ""),
        ("ERROR", "error", "Failed to fetch page", ""),
        ("NO_CONTENT", "none", "No sections found on page", ""),
    ]


def test_content_cap_counts_code_points(spark):
    html = "<h1>T</h1><p>" + "\U0001f600" * 6000 + "</p>"
    assert len(found(spark, html)[0][2]) == 5000
    assert len(found(spark, html, max_content=None)[0][2]) == 6000


def test_metadata(spark):
    html = [
        "<title> a &amp; b </title><meta content='d &quot;e&quot;' name=description>"
        "<link rel='x canonical' href=/c?a=1&amp;b=2>",
        "<META NAME='description' CONTENT=''><meta property='og:description' content=o>",
        "<!-- <title>no</title> --><script>'<title>no</title>'</script><link rel=canonical>",
        "<meta name=Description content=no><svg><title>first</title></svg><title>second</title>",
        "<noscript><meta name=description content=early></noscript><link rel=canonical href=''>",
    ]
    got = S.page_meta(pages(spark, *html)).orderBy("page_id").collect()
    assert [(r.page_title, r.description, r.canonical_url) for r in got] == [
        ("a & b", 'd "e"', "/c?a=1&b=2"), ("", "o", "http://p1"), ("", "", "http://p2"),
        ("first", "", "http://p3"), ("", "early", ""),
    ]


def test_headings(spark):
    html = "<h2>A</h2><h3></h3><div><h4>B</h4></div><h3>C</h3><h1>D</h1>"
    got = S.page_headings(pages(spark, html)).orderBy("head_no").collect()
    assert [(r.section_level, r.depth, r.title, r.next_no) for r in got] == [
        ("h2", 0, "A", 5), ("h3", 0, "", 4), ("h4", 1, "B", 4), ("h3", 0, "C", 5), ("h1", 0, "D", None)
    ]


def test_containers(spark):
    html = """<div class="Big-Card"><div><h2>A <i>b</i></h2></div><p>x</p><h3>C</h3> y</div>
      <div class=other><h2>no</h2></div><ul class=card><li><h2>no</h2></li></ul>"""
    got = S.container_sections(pages(spark, html)).orderBy("box_no").collect()
    assert [(r.section_title, r.content) for r in got] == [("Ab", "A b x C y"), ("C", "A b x C y")]
    html = "<article class='block'><h2>T</h2> rest</article>"
    (row,) = S.container_sections(pages(spark, html)).collect()
    assert row.content == "rest"
    deep = "<div class=card>" + "<div>" * 5 + "<h2>T</h2>"  # the card is the sixth ancestor
    assert S.container_sections(pages(spark, deep)).count() == 0


def test_long_pages_and_many_attributes(spark):
    tag = "<p " + " ".join(f'a{i}="v > {i}"' for i in range(20000)) + ">"
    html = "<h1>T</h1>" + tag + "x" + "<i>y</i>" * 3000 + "a < b " * 20000 + "<h2>U</h2>z"
    got = found(spark, html, max_content=None)
    assert got[1] == ("U", "h2", "z", "siblings")
    assert got[0][2].startswith("x | y | y") and got[0][2].endswith("a < b U z")


def test_many_headings_on_one_page(spark):
    n = 4000
    html = "<div class=card><h1>Top</h1>" + "".join(
        f"<div><h2>H{i}</h2><p>text <b>bold</b> {i}</p></div>" for i in range(n)
    )
    html += "</div>"
    got = found(spark, html, max_content=None)
    assert got[-1] == (f"H{n - 1}", "h2", f"text | bold | {n - 1}", "siblings")
    assert len(got) == n + 1 and got[0][2].endswith(f"| bold | {n - 1}")
    boxed = S.container_sections(pages(spark, html)).collect()
    assert len(boxed) == n + 1 and {len(r.content) for r in boxed} == {5000}


def test_one_shuffle(spark, as_table):
    table = as_table(pages(spark, "<h1>T</h1>x"))
    plan = S.extract_sections(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan and "BatchEvalPython" not in plan


def test_stray_end_tags_lose_no_text(spark):
    for stray in ("</ul>", "</div></div>", "</td>", "</section>", "</article></main>"):
        html = f"<body><h2>T</h2><p>one</p>{stray}<p>two</p><h2>U</h2><p>three</p></body>"
        assert found(spark, html) == [
            ("T", "h2", "one two", "siblings"), ("U", "h2", "three", "siblings")], stray
    html = "<div><h2>T</h2><p>one</p></ul><p>two</p></div>"
    assert found(spark, html) == [("T", "h2", "one two", "siblings")]


def test_unclosed_elements_change_no_other_section(spark):
    part = "<div><div><h2>B</h2></div><div>b</div></div><div>other</div>"
    closed = "<table><tr><td>x</td></tr></table>"
    for name in ("td", "li", "div", "section", "tr"):
        html = f"<h1>A</h1><p>a</p><{name}>open<p>c</p><h1>N</h1>{part}{closed}"
        got = found(spark, html)
        assert ("B", "h2", "b", "parent_siblings") in got, name
        assert got[0][2].replace(" | ", " ") == "a open c", name
    broken = "<h1>A</h1><table><tr><td>x</tr></table><p>y</p>" + part
    assert ("B", "h2", "b", "parent_siblings") in found(spark, broken)


def test_attributes_inside_values_do_not_count(spark):
    html = """<meta content="set name=description here" name="keywords">
      <meta data-x="1 content=bad" content="  Real  " NAME='description' name=other>
      <link data-rel="x rel=canonical href=/no" rel=next href=/n><link rel=canonical href=/yes/>"""
    row = S.page_meta(pages(spark, html)).first()
    assert row.description == "  Real  " and row.canonical_url == "/yes/"
    box = '<div title="a class=card"><div class=x data-class="box"><h2>T</h2>text</div></div>'
    assert S.container_sections(pages(spark, box)).count() == 0


def test_repeated_page_ids_fail(spark):
    import pytest

    twice = pages(spark, "<h1>A</h1>a").union(pages(spark, "<h1>B</h1>b"))
    with pytest.raises(Exception, match="page_id is not unique"):
        S.extract_sections(twice).collect()


def test_deep_nesting_of_boxes(spark):
    n = 1600
    html = "".join(f"<div class=box><h3>T{i}</h3>x{i} " for i in range(n)) + "</div>" * n
    got = S.container_sections(pages(spark, html), max_content=12).orderBy("box_no").collect()
    assert len(got) == n
    assert [(r.section_title, r.content) for r in got[-2:]] == [
        ("T1598", "x1598 T1599 "), ("T1599", "x1599")]
