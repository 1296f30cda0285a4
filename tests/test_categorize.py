import json

from pagesift.operators import categorize as C


def test_keyword_category(values):
    cases = {
        "About our products": "About/Company Overview",  # first category of two
        "iPhone": "Contact Information",
        "FRAMEWORK": "Case Studies/Portfolio",
        "Nothing": "Other",
        None: "Other",
        "": "Other",
    }
    assert values(C.keyword_category, cases) == list(cases.values())
    own = {"X": ("b",), "Y": ("a",)}
    assert values(lambda c: C.keyword_category(c, own), ["ab", "A", "c"]) == ["X", "Y", "Other"]


def test_reply_labels(values):
    cases = {
        ' ["a", "b"] ': ["a", "b"],
        '```json\n["a"]\n```': ["a"],
        '```\n["a"]```\ntext after': ["a"],
        "[]": [],
        '["a", null, 3]': ["a", None, "3"],
        '["a"] and more': None,
        "['a','b']": None,
        '["a"], "x": 1': None,
        '["a"], "labels": ["z"]': None,
        '["a"], ["b"]': None,
        '["a"]], [["b"]': None,
        '["a"]}, {"x": 1': None,
        '["a",]': None,
        '["a"': None,
        '{"x": ["a"]}': None,
        '"text"': None,
        "12": None,
        "": None,
        None: None,
    }
    assert values(C.reply_labels, cases) == list(cases.values())


def numbered(spark, n):
    return spark.createDataFrame(
        [(i + 1, f"About {i}", "c" * 300) for i in range(n)],
        "row_no long, section_title string, content string",
    )


def test_apply_replies(spark):
    replies = spark.createDataFrame(
        [(0, json.dumps([f"L{i}" for i in range(25)])), (1, '["only", null]'), (2, "no")],
        "batch_id long, reply string",
    )
    got = {r.row_no: r.ai_category for r in C.apply_replies(numbered(spark, 85), replies).collect()}
    assert [got[i + 1] for i in range(20)] == [f"L{i}" for i in range(20)]
    assert [got[i] for i in (21, 22, 23, 40)] == ["only", "", "Other", "Other"]
    # an unreadable reply, and batches without one, fall back to the keywords
    assert {got[i] for i in range(41, 86)} == {"About/Company Overview"}


def test_prompt_batches(spark):
    got = C.prompt_batches(numbered(spark, 45), ["K1", "K2"]).orderBy("batch_id").collect()
    assert [r.n_sections for r in got] == [20, 20, 5]
    assert "- K1\n- K2\n\nSections to categorize:\n1. Title: \"About 20\"" in got[1].prompt
    assert f'5. Title: "About 44" | Content preview: "{"c" * 200}..."' in got[2].prompt
