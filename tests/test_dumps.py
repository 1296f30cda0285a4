"""Openings that a text holds, and page dumps, against ``in``."""

import random

from pagesift.operators import dedup as D

SCHEMA = "url string, section_title string, section_level string, content string, pos int"


def rows(rng):
    out = []
    for u in range(60):
        letters = rng.choice(["ab", "ab ", "abcdefgh ", "ä🙂漢 b"])
        text = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: E731, B023
        subs = [text(rng.choice([10, 50, 51, 52, 74, 75, 99, 100, 101, 130, 260])) for _ in range(rng.randint(1, 6))]
        subs += rng.sample(subs, rng.randint(0, len(subs)))  # equal openings count each
        for k in range(rng.randint(0, 3)):
            chosen = [s for s in subs if rng.random() < 0.7]
            rng.shuffle(chosen)
            head = text(rng.randint(0, 60)) + text(rng.randint(0, 30)).join(chosen) + text(rng.randint(0, 60))
            out.append((f"u{u}", f"t{k}", "h1", rng.choice([head, head, head[:-40], ""])))
        out += [(f"u{u}", f"s{i}", f"h{rng.randint(2, 6)}", s) for i, s in enumerate(subs)]
    out += [(None, "t", "h1", "x" * 300)] + [(None, "s", "h2", "x" * n) for n in (51, 80, 100)]
    return [(*r, i) for i, r in enumerate(out)]


def dumps(table):
    want = set()
    for url, _, level, content, pos in table:
        subs = [c for u, _, lv, c, _ in table if u == url and lv in D.SUB_LEVELS]
        if level != "h1" or not content or len(subs) < 3 or url is None:
            continue
        if len(content) > 0.8 * sum(map(len, subs)):
            held = sum(len(s) > 50 and s[:100] in content for s in subs)
            if 2 * held >= len(subs):
                want.add(pos)
    return want


def test_random_pages(spark):
    rng = random.Random(9)
    found = 0
    for _ in range(4):
        table = rows(rng)
        df = spark.createDataFrame(table, SCHEMA)
        got = {r.pos for r in D.page_dumps(df).collect()}
        assert got == dumps(table)
        found += len(got)
    assert found > 20


def test_work_grows_with_the_text(spark):
    opening = "b" * 60
    for n in (2_000, 20_000):
        heads = spark.createDataFrame([("u", "p", "ab" * n + opening)], "url string, _print string, content string")
        many = [(f"{'ba' * 30}{i:05d}",) for i in range(n // 40)] + [(opening,)]
        openings = spark.createDataFrame([("u", o) for o, in many], "url string, _opening string")
        got = D.held_openings(heads, openings).collect()
        assert [r._opening for r in got] == [opening]


def test_texts_are_not_cut_into_rows(spark):
    """Only places that may hold an opening are rows; the openings are one row each."""
    text = "".join(random.Random(5).choice("abcdefghij ") for _ in range(50_000))
    heads = spark.createDataFrame([("u", "p", text), ("v", "q", text)], "url string, _print string, content string")
    some = [text[i : i + n] for i, n in ((0, 51), (7_000, 100), (49_900, 100))]
    openings = spark.createDataFrame([("u", o, i) for i, o in enumerate([*some, "z" * 60])], "url string, _opening string, _n long")
    found = D.held_openings(heads, openings)
    assert sorted((r.url, r._print, r._opening, r._n) for r in found.collect()) == sorted(("u", "p", o, i) for i, o in enumerate(some))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1
