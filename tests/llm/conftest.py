import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta. " * 20000

EDGES = [
    (1, "One line.\nTwo lines.\nThree lines.\nFour lines.", "en", "a/b.env", 10),
    (1, "One line.\nTwo lines.\nThree lines.\nFour lines.", "en", "a/b.env", 10),
    (2, "One line.\nTwo lines.\nThree lines.\nElse.", None, None, None),
    (3, "", "en", "s", 0),
    (4, None, "en", "s", None),
    (None, "a row without an id, all rights reserved", None, "s", 4),
    (None, None, None, None, None),
    (5, LONG, "en", "s", len(LONG)),
    (6, "   \n\n\n   \n\t", "en", "s", 5),
    (7, "word", "en", "s", 4),
    (8, "ünï çødé ☃ 漢字 cc by", "xx", "s", 3),
    (1, "the same id, another text, api_key = 9f8a7b6c5d4e3f2a1b0c", "en", "s", 1),
]

#: Names that operators use themselves.
CLASHES = ("score", "n_words", "hits", "token", "h", "f", "row", "id", "rep", "hash", "place",
           "n", "label", "y", "_id", "at", "part", "th", "p_toxic", "n_lines", "a.b")


@pytest.fixture(scope="session", autouse=True)
def _workers(spark):
    from pagesift.llm.queries import importable

    importable(spark)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(edges):
    return edges.where("false")
