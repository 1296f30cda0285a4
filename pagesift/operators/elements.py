"""The element tree of a page, as what each tag opens and closes.

A stack of open elements is folded over the tags of a page: a start tag opens an element, and
ends one whose end tag may be left out before it; an end tag closes its element and all that was
opened inside, whatever their own end tags say later. An end tag without an open element
closes nothing, nor does one whose element holds an open one of a higher rank.

The fold is one pass over a page and the only thing that Python does here: the tags of a
batch of pages come and the numbers go as Arrow lists, the texts stay where they are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that hold others count for depth.
CONTAINERS = (
    "html", "body", "div", "section", "article", "main", "header", "footer", "nav", "aside",
    "ul", "ol", "dl", "table", "form", "fieldset", "figure", "blockquote", "details",
    "li", "dt", "dd", "tr", "td", "th",
)
# Elements that end when one of these begins right inside of them.
ENDED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
    "tr": ("tr", "td", "th"),
}
# The end tag of an element of a lower rank (0, if none is given) does not close these.
RANK = {"div": 1, "td": 2, "th": 2, "tr": 3, "table": 4, "body": 5, "html": 6}


def _fold(containers: tuple[str, ...], ended_by: dict, rank: dict):
    """A function of the tags of one page; nested, so that workers need not have this module."""
    higher = {c: [h for h, r in rank.items() if r > rank.get(c, 0)] for c in containers}

    def steps(tags: list[str]) -> list[int]:
        stack: list[str] = []
        where: dict[str, list[int]] = {c: [] for c in containers}
        out = [0] * len(tags)

        def close(to: int) -> int:
            n = len(stack) - to
            while len(stack) > to:
                where[stack.pop()].pop()
            return n

        for i, tag in enumerate(tags):
            if tag in where:
                to, ends = len(stack), ended_by.get(tag, ())
                while to and stack[to - 1] in ends:
                    to -= 1
                out[i] = 2 * close(to) + 1
                where[tag].append(len(stack))
                stack.append(tag)
            elif tag[:1] == "/" and (places := where.get(tag[1:])):
                last = places[-1]
                if not any(where[h] and where[h][-1] > last for h in higher[tag[1:]]):
                    out[i] = 2 * close(last)
        return out

    return steps


def element_steps(tags: Column) -> Column:
    """For each of an array of tag names (an end tag has its slash): twice the number of
    elements it closes, plus 1 if it opens one."""
    steps = _fold(CONTAINERS, ENDED_BY, RANK)

    @F.arrow_udf("array<int>")
    def of_pages(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else steps(p) for p in pages.to_pylist()], pa.list_(pa.int32()))

    return of_pages(tags)
