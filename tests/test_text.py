import html
import html.entities
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesift.functions import text as T
from pagesift.sources.rules import DEFAULT_RULES


def test_clean_text(values):
    cases = {
        None: "",
        "": "",
        "<br><p>": "",
        "a &amp; b&nbsp;c &#160;d &#xA0;e": "a b c d &#xA0;e",
        "see https://x.org/a?b=1 now": "see now",
        "HTTPS://x.org stays": "HTTPS://x.org stays",
        "a 　b\u001cc d\n\te": "a b c d e",
        "1 < 2 and 3": "1 < 2 and 3",
        "1 < 2 > 3": "1 3",
        "&am<i>p;": "&am p;",
        "<a\nhref=x>y</a>": "y",
        "​zero width stays": "​zero width stays",
        "&#٣;x": "x",
    }
    assert values(T.clean_text, cases) == list(cases.values())


def test_one_pass_equals_passes_in_turn(spark):
    """The merged markup pattern against its three parts, and the space class, on odd texts."""
    alphabet = st.text(st.sampled_from("<>&#;ab1 \n\t \u001d　/:htps"), max_size=25)

    @settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(alphabet, min_size=300, max_size=400))
    def check(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
        got = [r.y for r in sorted(df.select("i", T.clean_text("x").alias("y")).collect())]
        want = []
        for t in texts:
            for pattern, new in (("<[^>]+>", " "), ("&[a-zA-Z]+;", " "), (r"&#\d+;", " "),
                                 (r"https?://\S+", "")):
                t = re.sub(pattern, new, t)
            want.append(" ".join(t.split()))
        assert got == want

    check()


def test_strip_phrases(values):
    phrases = DEFAULT_RULES.boilerplate_phrases
    cases = {
        "Click HERE to read more": "to",
        "Skip to View allcontent": "",  # removing one phrase makes a later one
        "Click Read morehere": "Click here",  # but not an earlier one
        "unclick hereby": "unby",
        "top /$a b$ end $w . $  $ Anchor 42 x": "top end x",
        "cİick here cıick": "cİick here cıick",
        "clİck here, clıck here": ",",
        "ſee more": "",
        "nothing  at all": "nothing at all",
    }
    assert values(lambda c: T.strip_phrases(c, phrases), cases) == list(cases.values())
    assert values(lambda c: T.strip_phrases(c, ["a|b", r"\d+"]), ["xAby12 z"]) == ["xy z"]
    assert values(lambda c: T.strip_phrases(c, []), [" x  y "]) == ["x y"]


def test_phrases_are_found_wherever_their_literal_start_is():
    assert T.literal_start(r"Loading\.\.\.") == "loading..."
    assert T.literal_start(r"Anchor \d+") == "anchor "
    assert T.literal_start("ab*c") == "a"
    assert T.literal_start("a|b") == ""
    assert T.literal_start("(x)y") == ""
    assert T.literal_start("éa") == ""


def test_word_count(values):
    assert values(T.word_count, [None, "", " ", "a", " a  b\n c "]) == [0, 0, 0, 1, 3]


def test_flatten_newlines(values):
    texts = ["a\nb", "\n a\n", None, "a\r\nb"]
    assert values(T.flatten_newlines, texts) == ["a | b", "|  a |", "", "a\r | b"]
    assert values(lambda c: T.flatten_newlines(c, " "), texts) == ["a b", "a", "", "a\r b"]


def test_decode_entities(values):
    cases = {
        "&amp;nbsp;": "&nbsp;",
        "&lt;b&gt; &eacute;&apos;": "<b> é'",
        "&#8212;&#x1F600;&#X41;": "—\U0001f600A",
        "&unknown; &copy &": "&unknown; © &",
        "&copy 2024&copy2024 &ampx &ltp&gt &notit; &notin; &#65 &#x42g &#; &#x;": (
            "© 2024©2024 &x <p> ¬it; ∉ A Bg &#; &#x;"
        ),
        "&#0;&#xD800;": "��",
        "&#0000000169;&#x000000A9;&#00000000000000;": "©©�",
        "&#99999999999999999999;&#xFFFFFFFFFFFFFFFFFF;": "��",
        "plain": "plain",
        None: None,
    }
    assert values(T.decode_entities, cases) == list(cases.values())
    # HTML 5 moved the angle brackets; an HTML 4 parser has the old ones.
    assert T.ENTITIES["lang"] == "\u2329" and T.ENTITIES["rang"] == "\u232a"
    for name in T.ENTITIES.keys() - {"lang", "rang"}:
        assert html.unescape(f"&{name};") == T.ENTITIES[name]


def test_decode_as_the_rules_for_texts_have_it(values):
    rng = random.Random(1)
    names = [*T.LOOSE_ENTITIES, *(n + ";" for n in T.ENTITIES if n not in ("lang", "rang")), "no", "am"]
    texts = []
    for _ in range(3000):
        bits = [rng.choice(["&", "&&", "&#65", "&#x4a;", "a&"]) + rng.choice(["", rng.choice(names)])
                + rng.choice(["", " ", "x", ";", "=1", "9"]) for _ in range(rng.randint(1, 4))]
        texts.append("".join(bits))
    # Names that only the later standard has are left out of the comparison.
    later = {n.rstrip(";") for n in html.entities.html5} - T.LOOSE_ENTITIES.keys() - T.ENTITIES.keys()
    texts = [t for t in texts if not any(f"&{n};" in t for n in later)]
    assert len(texts) > 2500
    assert values(T.decode_entities, texts) == [html.unescape(t) for t in texts]


def test_addresses_keep_their_parameters(values):
    links = ["?a=1&copy=2", "?a&copy2", "x &copy y", "&copy", "?a=1&amp;lt=3&#65;", "?n&#65=1"]
    want = ["?a=1&copy=2", "?a&copy2", "x © y", "©", "?a=1&lt=3A", "?n&#65=1"]
    assert values(lambda c: T.decode_entities(c, attribute=True), links) == want


def test_space_class_is_pythons(spark):
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    found = df.where(F.col("c").rlike(f"^[{T.SPACE}]$") | F.col("c").rlike(r"^\n$")).collect()
    assert {r.c for r in found} == {c for c in chars if c.isspace()}
    left = df.where(T.strip("c") == "").collect()
    assert {r.c for r in left} == {c for c in chars if c.isspace()}
    collapsed = df.where(T.collapse_space(F.concat(F.lit("a"), "c", F.lit("b"))) == "a b")
    assert {r.c for r in collapsed.collect()} == {c for c in chars if c.isspace()}


def test_phrases_are_looked_for_where_their_start_is(spark):
    """A phrase that another one's deletion leaves behind counts; odd letters have all looked for."""
    phrases = list(DEFAULT_RULES.boilerplate_phrases)
    texts = ["Learn Click here more", "Read mLoading...ore", "Read Loading...more", "clicK here ſee more",
             "REaD more  x", "Anchor 12 /$a$ Back\tto top", "", "nothing  of it ", None, "İ see more"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    plain = F.col("x")
    for p in phrases:
        plain = F.regexp_replace(plain, f"(?iuU){p}", "")
    out = df.select(T.strip_phrases("x", phrases).alias("got"), T.collapse_space(plain).alias("want"))
    assert all(r.got == r.want for r in out.collect())
    one = df.select(T.strip_phrases("x", phrases))._jdf.queryExecution().optimizedPlan().toString()
    assert one.lower().count("contains(") >= 2 * len(set(map(T.literal_start, phrases)))


def test_names_of_entities_are_dealt_into_small_maps(spark, values):
    names = [f"&{n};x&{n}" for n in T.ENTITIES]
    assert values(T.decode_entities, names) == [
        T.ENTITIES[n] + "x" + (T.LOOSE_ENTITIES[n] if n in T.LOOSE_ENTITIES else
                               next((T.LOOSE_ENTITIES[n[:k]] + n[k:] for k in range(len(n), 1, -1) if n[:k] in T.LOOSE_ENTITIES), "&" + n))
        for n in T.ENTITIES
    ]
    codes = [0, 1, 65, 0x7F, 0x80, 0x7FF, 0x800, 0xD7FF, 0xD800, 0xE000, 0xFFFF, 0x10000, 0x10FFFF, 0x110000, 10**9]
    want = [chr(c) if 0 < c < 0xD800 or 0xDFFF < c < 0x110000 else "�" for c in codes]
    for form in ("&#{};", "&#x{:x};", "&#0000000{}", "&#X00000000{:X};"):
        assert values(T.decode_entities, [form.format(c) for c in codes]) == want
    sizes = T._looked_up(T.ENTITIES, F.lit("amp"))._jc.toString()
    assert max(part.count("\t") for part in sizes.split("str_to_map")) < 16
