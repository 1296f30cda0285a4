"""A corpus cleaned in stages, each written as Parquet and read again by the next.

The stages keep the columns of documents but for the last, which returns packed pieces:

1. quality classifier: documents that it rejects go;
2. line dedup: windows of three lines that stood before are removed from the texts, and
   ``n_chars`` follows;
3. n-gram Jaccard join on five-word shingles at 0.8: one row of each group stays, the first
   one of the smallest id, or of none, so documents without near duplicates stay;
4. benchmark decontamination: rows that hold a copy of a benchmark item go;
5. packing: what is left is packed into windows of 1,024 tokens.

A row whose id is null or repeated is treated like any other: the Jaccard join links rows by
numbers of their own, and decontamination tells rows of one id apart by their texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm import decontaminate, jaccard, line_dedup, packing, quality
from pagesift.llm.queries import importable
from pagesift.sources.staging import (
    new_folder, release, remove_staged, stage, staged_in, staging_root,
)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
OWN = ("doc_id", "text", "n_chars")


def same_columns(apply: Stage) -> Stage:
    """The stage under plain names: other columns may be called like an operator's own, or
    hold dots, and come back as they were."""

    @wraps(apply)
    def renamed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        importable(spark)
        names = [c if c in OWN else f"_other{i}" for i, c in enumerate(docs.columns)]
        return apply(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return renamed


@same_columns
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("score >= 0.5")


@same_columns
def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


@same_columns
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Numbers that do not change when a task is repeated: they are written with the rows.
    rows = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    groups = jaccard.link_components(rows.select("_row", "text"), 80, 100, 5, "_row")
    groups = groups.select(F.col("id").alias("_row"), F.col("component_id").alias("_group"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    placed = stage(
        groups.join(rows.select("_row", "doc_id"), "_row")
        .select("_group", "_row", order.alias("_order")),
        "pipeline-groups",
    )
    first = placed.groupBy("_group").agg(F.min("_order").alias("_first"))
    gone = placed.join(first, "_group").where(F.col("_order") != F.col("_first")).select("_row")
    gone = stage(gone, "pipeline-copies")
    release(placed)
    return rows.join(gone, "_row", "left_anti")


@same_columns
def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", fresh_lines),
    ("ngram_jaccard", one_of_each),
    ("decontamination", no_benchmark),
    ("packing", packed),
]

#: The classifier and the tokenizer cannot be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table ``documents``.

    What a stage writes for itself goes when its rows are written, and so do the rows of
    the stage before.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    root = staging_root(spark)
    for name, apply in STAGES:
        own = new_folder(spark, f"pipeline-{name}-work")
        with staged_in(spark, own):
            out = apply(spark, docs, sf_dir)
            with staged_in(spark, root):
                docs = stage(out, f"pipeline-{name}")
        remove_staged(spark, own)
        if before is not None:
            release(before)
        before = docs
    return docs
