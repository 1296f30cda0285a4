"""Section contents of random well-formed trees against the rules spelled out on the tree."""

import random

from pagesift.operators.sections import extract_sections


class Node:
    def __init__(self, tag, parent):
        self.tag, self.parent, self.children = tag, parent, []
        if parent:
            parent.children.append(self)

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()

    def following(self):
        if not self.parent:
            return []
        siblings = self.parent.children
        return siblings[siblings.index(self) + 1:]


def html(node):
    if node.tag == "#":
        return node.text
    return f"<{node.tag}>" + "".join(html(c) for c in node.children) + f"</{node.tag}>"


def add_text(rng, parent):
    if not parent.children or parent.children[-1].tag != "#":
        Node("#", parent).text = rng.choice(["x", "y", " z\n w ", "q", "  ", "long text"])


def add_inline(rng, parent, depth=2):
    node = Node(rng.choice(["b", "span", "a"]), parent)
    for _ in range(rng.randint(0, 2)):
        add_inline(rng, node, depth - 1) if depth and rng.random() < 0.3 else add_text(rng, node)


def grow(rng, parent, depth):
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.28:
            heading = Node(f"h{rng.randint(1, 4)}", parent)
            for _ in range(rng.randint(0, 2)):
                add_inline(rng, heading, 0) if rng.random() < 0.3 else add_text(rng, heading)
        elif kind < 0.45:
            p = Node("p", parent)
            for _ in range(rng.randint(0, 3)):
                add_inline(rng, p) if rng.random() < 0.4 else add_text(rng, p)
        elif kind < 0.55:
            add_inline(rng, parent)
        elif kind < 0.63:
            add_text(rng, parent)
        elif depth and kind < 0.75:
            ul = Node("ul", parent)
            for _ in range(rng.randint(1, 3)):
                grow(rng, Node("li", ul), depth - 1)
        elif depth and kind < 0.82:
            table = Node("table", parent)
            for _ in range(rng.randint(1, 2)):
                row = Node("tr", table)
                for _ in range(rng.randint(1, 3)):
                    grow(rng, Node("td", row), depth - 1)
        elif depth:
            grow(rng, Node(rng.choice(["div", "section"]), parent), depth - 1)


def pieces(node, place, end):
    return [n.text.strip() for n in node.walk()
            if n.tag == "#" and n.text.strip() and place[n] < end]


def expected(root):
    place = {n: i for i, n in enumerate(root.walk())}
    headings = [n for n in root.walk() if n.tag[0] == "h" and n.tag[1:].isdigit()]
    out = []
    for i, h in enumerate(headings):
        title = "".join(pieces(h, place, 10**9))
        if not title:
            continue
        end = next((place[g] for g in headings[i + 1:] if g.tag <= h.tag), 10**9)
        at, content = h, ""
        for _ in range(3):
            found = [" | ".join(pieces(s, place, end)) for s in at.following() if place[s] < end]
            content = " ".join(" ".join(found).split())
            if content or not at.parent:
                break
            at = at.parent
        if not content:
            start, seen = place[h], []
            for n in root.walk():
                if n.tag == "#" and start < place[n] < end and n.text.strip() not in ["", *seen]:
                    seen.append(n.text.strip())
            content = " ".join(" ".join(seen).split())
        out.append((title, h.tag, content))
    return out


def test_random_trees(spark):
    rng = random.Random(7)
    roots = []
    for _ in range(600):
        root = Node("body", None)
        grow(rng, root, 4)
        roots.append(root)
    df = spark.createDataFrame(
        [(i, f"u{i}", html(r)) for i, r in enumerate(roots)], "page_id long, url string, html string"
    )
    got = {}
    rows = extract_sections(df).where("content_source not in ('main', 'none')")
    for r in sorted(rows.collect(), key=lambda r: (r.page_id, r.sec_no)):
        got.setdefault(r.page_id, []).append((r.section_title, r.section_level, r.content))
    wrong = 0
    for i, root in enumerate(roots):
        want = expected(root)
        if got.get(i, []) != want:
            wrong += 1
            if wrong < 4:
                print(html(root), "\n got ", got.get(i), "\n want", want)
    assert wrong == 0
    assert sum(map(len, got.values())) > 1500
