"""Broken pages: element trees against a parser that builds them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagesift.operators import elements as E
from pagesift.operators.sections import container_sections, extract_sections, page_headings
from tests.test_sections_brute_force import Node, expected, grow, html

BLOCKS = (*E.CONTAINERS, "p", *(f"h{i}" for i in range(1, 7)))


def parse(page):
    """The tree of a page, element by element; leaves end where a block begins or ends."""
    root = here = Node("page", None)

    def path(node):
        while node:
            yield node
            node = node.parent

    for token in re.findall("<[^>]*>|[^<]+", page):
        if token[0] != "<":
            Node("#", here).text = token
            continue
        ends, name = re.match("<(/?)([a-z0-9]+)", token).groups()
        if name in BLOCKS:
            # What is inline, a paragraph or a heading is left when a block begins or ends.
            stray = ends and name in E.CONTAINERS and not closable(here, name)
            while not stray and here.tag not in E.CONTAINERS and here is not root:
                here = here.parent
        if name in E.CONTAINERS and not ends:
            while here.tag in E.ENDED_BY.get(name, ()):
                here = here.parent
            here = Node(name, here)
        elif name in E.CONTAINERS:
            if closable(here, name):
                here = next(n for n in path(here) if n.tag == name).parent
        elif not ends:
            here = Node(name, here)
        elif here.tag == name:
            here = here.parent
    return root


def closable(here, name):
    while here:
        if here.tag == name:
            return True
        if E.RANK.get(here.tag, 0) > E.RANK.get(name, 0):
            return False
        here = here.parent
    return False


def broken(rng, page):
    """Some end tags of containers and paragraphs left out, late, or put in."""
    out = []
    for token in re.findall("<[^>]*>|[^<]+", page):
        name = token.strip("</>")
        if token.startswith("</") and name in (*E.CONTAINERS, "p"):
            what = rng.random()
            if what < 0.2:
                continue
            if what < 0.3 and name != "p":
                out.append(f"</{rng.choice(['ul', 'div', 'li', 'td', 'section', 'table'])}>")
        out.append(token)
    return "".join(out)


def steps_of(tags):
    return E._fold(E.CONTAINERS, E.ENDED_BY, E.RANK)(tags)


def by_parser(tags):
    """Closed and opened elements of each tag from a plain list of the open ones."""
    out, stack = [], []
    for t in tags:
        before = len(stack)
        if t in E.CONTAINERS:
            while stack and stack[-1] in E.ENDED_BY.get(t, ()):
                stack.pop()
            out.append(2 * (before - len(stack)) + 1)
            stack.append(t)
            continue
        if t[:1] == "/" and t[1:] in stack:
            at = max(i for i, x in enumerate(stack) if x == t[1:])
            if all(E.RANK.get(x, 0) <= E.RANK.get(t[1:], 0) for x in stack[at:]):
                del stack[at:]
        out.append(2 * (before - len(stack)))
    return out


def test_fold_against_a_list_of_open_elements():
    rng = random.Random(1)
    names = ["div", "ul", "li", "table", "tr", "td", "th", "dl", "dt", "dd", "section", "body", "p", ""]
    for _ in range(3000):
        tags = [rng.choice(["", "/"]) + rng.choice(names) for _ in range(rng.randint(0, 40))]
        assert steps_of(tags) == by_parser(tags), tags


def test_fold_is_linear():
    for tags in (["div"] * 50000 + ["/ul"] * 50000, ["ul", "div"] + ["section"] * 50000 + ["/ul"] * 50000,
                 ["li"] * 50000, ["ul", "li"] * 50000 + ["/ul"] * 60000):
        assert len(steps_of(tags)) == len(tags)


@pytest.mark.parametrize("seed", [3, 4])
def test_random_broken_pages(spark, seed):
    rng = random.Random(seed)
    pages = []
    for _ in range(400):
        root = Node("body", None)
        grow(rng, root, 4)
        pages.append(broken(rng, html(root)))
    df = spark.createDataFrame(
        [(i, f"u{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string"
    )
    got = {}
    for r in extract_sections(df).where("content_source not in ('main', 'none')").collect():
        got.setdefault(r.page_id, {})[r.sec_no] = (r.section_title, r.section_level, r.content)
    for i, page in enumerate(pages):
        own = got.get(i, {})
        assert [own[k] for k in sorted(own)] == expected(parse(page)), page
    assert sum(map(len, got.values())) > 800


def sections(spark, *pages):
    df = spark.createDataFrame(
        [(i, f"u{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string"
    )
    rows = extract_sections(df).orderBy("page_id", "sec_no").collect()
    return [(r.section_title, r.content) for r in rows]


def test_elements_closed_late_or_never(spark):
    assert sections(
        spark,
        "<div><ul><li>a</ul><h2>T</h2><p>b</p></li><p>c</p></div>",
        "<div><h2>T</h2><p>one</p></ul><p>two</p></div>",
        "<ul><li><h2>T</h2><p>x</p><li><p>y</p></ul>",
        "<table><tr><td><h2>T</h2>x<td>y<tr><td>z</table>",
        "<div><table><tr><td></div><h2>T</h2><p>in</p></table><p>out</p></div>",
        "<div><h2>T</h2><p>in</p><section><p>open",
    ) == [("T", "b c"), ("T", "one two"), ("T", "x"), ("T", "x"), ("T", "in"), ("T", "in open")]


def test_a_container_that_stays_open(spark):
    df = spark.createDataFrame(
        [(1, "u", "<p>before</p><div class=card><h2>T</h2><p>a</p><section><p>b"),
         (2, "u", "<div class=card><ul><li><h2>T</h2></div><p>after</p>")],
        "page_id long, url string, html string",
    )
    got = [tuple(r) for r in container_sections(df).orderBy("page_id").collect()]
    assert got == [(1, 1, "T", "a b"), (2, 1, "T", "")]


def test_pages_without_an_id_and_of_one_id(spark):
    page = "<h1>T</h1><p>a</p>"
    rows = [(None, "u", page), (None, "v", page), (3, "w", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r.page_id for r in extract_sections(df).collect()] == [3]
    assert [r.page_id for r in page_headings(df).collect()] == [3]
    twice = df.withColumn("page_id", F.lit(7).cast("long"))
    with pytest.raises(Exception, match="page_id is not unique: 7"):
        extract_sections(twice).collect()
