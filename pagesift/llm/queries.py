"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm import (
    conversations, decontaminate, jaccard, licenses, line_dedup, neighbours, packing,
    periodic_runs, pieces, quality, secrets, suffixes, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def importable(spark: SparkSession) -> None:
    """Lets Python workers that see this folder import the package from it.

    On a cluster that does not share it the package is installed or sent with the job.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op6_line_windows", line_dedup.oracle())
def _op6(spark, sf):
    return line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))


@register("op4_nb_support_vectors")
def _op4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf, "labels"))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@register("op9_bounded_space_packing")
def _op9(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


@register("op3_fuzzy_notices")
def _op3(spark, sf):
    return licenses.digest(licenses.find_notices(table(spark, sf, "documents").select("doc_id", "text")))


@register("op8_classifier_chain")
def _op8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, table(spark, sf, "labels"))
    scored = toxicity.score(docs, chain).drop("text")
    toxic = F.when(F.col("p_toxic") >= 0.5, 1).otherwise(0)
    return scored.select(
        "doc_id", F.col("p_toxic").alias("score"), toxic.alias("predicted"), toxic.alias("toxic"),
        "p_kind_1", "p_kind_2",
    )


@register("op2_template_windows")
def _op2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    copies = decontaminate.find_copies(docs, table(spark, sf, "benchmark"))
    return copies.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"),
        F.col("start").alias("first_word"), F.col("end").alias("end_word"), "coverage", "kind",
        F.size("slots").cast("long").alias("n_slots"),
    )


@register("op7_hash_prefix_forest")
def _op7(spark, sf):
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@register("op1_secret_forest")
def _op1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    found = secrets.scan(docs)
    return found.select(
        F.col("id").alias("doc_id"), "place", "finding", "score",
        F.col("is_secret").cast("int").alias("predicted"),
    )


@register("op5_token_group_matrix", jaccard.oracle(90, 100, 3))
def _op5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return jaccard.link_components(docs, 90, 100, 3).withColumnRenamed("id", "doc_id")


@register("op10_deep_shallow")
def _op10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return suffixes.remove_repeats(docs).withColumnRenamed("id", "doc_id")


@register("op11_suffix_automaton")
def _op11(spark, sf):
    rows = table(spark, sf, "conversations")
    found, repaired = conversations.repair(conversations.damage(rows))
    hashes = conversations.text_hashes(repaired)
    every = rows.select("conv_id").distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    told = every.join(
        found.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left"
    ).drop("c").join(
        hashes.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left"
    )
    return told.select(
        "conv_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@register("op12_backtracking_pieces")
def _op12(spark, sf):
    coded = pieces.encode(table(spark, sf, "documents").select("doc_id", "text"))
    told = pieces.decode(coded)
    return told.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register("op13_grammar_runs")
def _op13(spark, sf):
    docs = periodic_runs.plant_runs(table(spark, sf, "documents"))
    found = periodic_runs.find_runs(docs).withColumn("best", periodic_runs.strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = F.col("best")
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
