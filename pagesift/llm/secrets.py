"""Secret scan whose false positives a random forest removes.

A finding is a run of at least ``MIN_LENGTH`` key characters with a digit in it, anywhere in
a text. Its features are its length, the transitions between its characters, how much of
it words of the corpus cover, the path it was found under, and the words beside it. A
random forest fitted on labelled findings gives each finding the probability to be a
secret; those below one half are false positives.

Where nobody has reviewed findings, ``seed_labels`` labels them by what they are assigned
to: beside a name of a secret they are secrets, beside any other word they are none.

Defined results: a null or empty text has no findings; repeated rows have the findings of
each; a null path is an empty one; a null label is not used; without labelled findings of
both classes every finding counts as a secret (probability 1); equal findings have equal
features but for what stands beside them. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.columns import named
from pagesift.llm.line_dedup import once
from pagesift.sources.staging import stage

MIN_LENGTH = 16
#: Labelled findings of each class the forest is fitted on: the first by a hash.
SAMPLE_PER_CLASS = 10000
TREES, DEPTH = 30, 8
#: Parts of findings that are broadcast to the words of the corpus; more are joined by a shuffle.
BROADCAST_PARTS = 1_000_000

SECRET_NAMES = (
    "token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "key",
    "access_key", "private_key", "client_secret", "auth", "authorization", "bearer", "credential",
    "credentials", "signature",
)
HARMLESS_NAMES = (
    "example", "sample", "test", "dummy", "placeholder", "sha", "sha1", "sha256", "md5", "commit",
    "checksum", "digest", "hash", "uuid", "guid", "id", "version", "number", "phone", "card",
)

FEATURES = (
    "length", "runs", "changes_digit", "pairs", "distinct", "digits", "capitals", "symbols",
    "hex", "coverage", "path_depth", "path_test", "path_config", "name_beside", "name_near",
    "harmless_near", "word_before", "word_after", "number_before",
)


def _cores(word: Column) -> Column:
    """The runs of a word that have a digit."""
    run = r"([A-Za-z0-9][A-Za-z0-9+/_.\-]{%d,}[A-Za-z0-9])" % (MIN_LENGTH - 2)
    return F.filter(F.regexp_extract_all(word, F.lit(run), F.lit(1)), lambda x: x.rlike("[0-9]"))


def findings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source"
) -> DataFrame:
    """(id, path, place, finding, before, before2, after): findings and the words beside them.

    Words are what blanks, quotes, brackets and signs of assignment leave; places count them,
    and the findings of one word share its place.
    """
    doc, text, path = named([id_col, text_col, path_col])
    cut = F.split(text, r"[\s\"'`,;(){}<>\[\]|=:]+")

    def found(words: Column) -> Column:
        def one(word, i):
            near = [F.lower(F.coalesce(F.get(words, i + d), F.lit(""))) for d in (-1, -2, 1)]
            long = F.length(word) >= MIN_LENGTH
            return F.when(
                long & word.rlike("[0-9]"),
                F.transform(
                    _cores(word),
                    lambda core: F.struct(
                        i.cast("long").alias("place"), core.alias("finding"),
                        near[0].alias("before"), near[1].alias("before2"), near[2].alias("after"),
                    ),
                ),
            )

        return F.flatten(F.filter(F.transform(words, one), lambda x: x.isNotNull()))

    # Most texts hold no candidate; a plain search tells before anything is split.
    some = docs.where(text.rlike(r"[A-Za-z0-9+/_.\-]{%d}" % MIN_LENGTH) & text.rlike("[0-9]"))
    return some.select(
        doc.alias("id"), F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        F.explode(once(cut, found)).alias("f"),
    ).select("id", "path", "f.*")


def _parts(finding: Column) -> Column:
    return F.regexp_extract_all(F.lower(finding), F.lit("([a-z]{4,})"), F.lit(1))


def coverage(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(finding, covered): how many letters of a finding words of two or more texts cover."""
    text = named([text_col])[0]
    parts = stage(
        found.select("finding").distinct().select("finding", F.explode(_parts("finding")).alias("part")),
        "secret-parts",
    )
    wanted = parts.select(F.col("part").alias("word")).distinct()
    if parts.count() <= BROADCAST_PARTS:
        wanted = F.broadcast(wanted)
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z]+"))).alias("word"))
    known = (
        words.where(F.length("word") >= 4).join(wanted, "word", "left_semi")
        .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        .select(F.col("word").alias("part"))
    )
    return parts.join(known, "part").groupBy("finding").agg(F.sum(F.length("part")).alias("covered"))


def features(found: DataFrame, covered: DataFrame) -> DataFrame:
    """``found`` with a column for each feature."""
    f, path = F.col("finding"), F.lower(F.col("path"))
    n = F.length(f).cast("double")

    def share(keep: str) -> Column:
        return F.length(F.regexp_replace(f, f"[^{keep}]", "")) / n

    chars = F.split(f, "")
    pairs = F.array_distinct(F.zip_with(chars, F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, b)))
    before, before2, after = F.col("before"), F.col("before2"), F.col("after")

    def is_name(word: Column, names: tuple[str, ...]) -> Column:
        return word.isin(*names) | F.element_at(F.split(word, "[^a-z0-9]+"), -1).isin(*names)

    word = "^[^0-9]{2,}$"
    columns = {
        "length": n,
        "runs": F.length(F.regexp_replace(f, "[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+", "x")) / n,
        "changes_digit": F.length(F.regexp_replace(f, "[0-9]+|[^0-9]+", "x")) / n,
        "pairs": F.size(pairs) / n,
        "distinct": F.size(F.array_distinct(chars)) / n,
        "digits": share("0-9"), "capitals": share("A-Z"), "symbols": 1 - share("a-zA-Z0-9"),
        "hex": F.lower(f).rlike("^[0-9a-f]+$"),
        "coverage": F.coalesce(F.col("covered"), F.lit(0)) / n,
        "path_depth": F.size(F.split(path, "/")),
        "path_test": path.rlike("test|example|sample|fixture|mock|doc"),
        "path_config": path.rlike("env|config|setting|credential|secret|deploy"),
        "name_beside": is_name(before, SECRET_NAMES),
        "name_near": is_name(before, SECRET_NAMES) | is_name(before2, SECRET_NAMES),
        "harmless_near": is_name(before, HARMLESS_NAMES) | is_name(before2, HARMLESS_NAMES),
        "word_before": before.rlike(word), "word_after": after.rlike(word),
        "number_before": before.rlike("^[0-9]"),
    }
    joined = found.join(covered, "finding", "left").drop(*FEATURES)
    return joined.withColumns(
        {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in columns.items()}
    ).drop("covered")


def seed_labels(featured: DataFrame) -> DataFrame:
    """``featured`` with ``label`` 1 beside a name of a secret, 0 beside another word.

    Findings beside neither a name nor a word, as after a number or at the start, have none.
    """
    name = F.col("name_beside") == 1
    other = (F.col("word_before") == 1) & (F.col("name_near") == 0)
    return featured.withColumn("label", F.when(name, 1).when(other, 0))


def fit(labelled: DataFrame, per_class: int = SAMPLE_PER_CLASS):
    """A random forest over labelled findings (``features`` and ``label`` 0 or 1), or None."""
    key = F.xxhash64("finding", "place", "id")
    columns = ["label", *FEATURES]
    classes = [
        labelled.where(F.col("label") == y).orderBy(key, "id", "place").select(*columns)
        .limit(per_class)
        for y in (0, 1)
    ]
    sample = stage(classes[0].unionByName(classes[1]), "secret-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=11,
        featureSubsetStrategy="sqrt",
    )
    return forest.fit(rows)


def classify(featured: DataFrame, model) -> DataFrame:
    """``featured`` with ``score``, the probability to be a secret."""
    if model is None:
        return featured.withColumn("score", F.lit(1.0))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured)
    scored = model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), 1))
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def scan(
    docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id",
    text_col: str = "text", path_col: str = "source",
) -> DataFrame:
    """(id, place, finding, before, score, is_secret) of every finding.

    ``labelled`` may hold reviewed findings: ``id``, ``place``, ``label``, and ``finding`` to
    tell those of one place apart.
    """
    found = stage(findings(docs, id_col, text_col, path_col), "secret-findings")
    featured = stage(features(found, coverage(found, docs, text_col)), "secret-features")
    if labelled is None:
        training = seed_labels(featured)
    else:
        keys = [c for c in ("id", "place", "finding") if c in labelled.columns]
        training = featured.join(labelled.select(*keys, "label"), keys)
    scored = classify(featured, fit(training))
    return scored.select(
        "id", "place", "finding", "before", "score", (F.col("score") >= 0.5).alias("is_secret")
    )
