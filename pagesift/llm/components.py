"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.sources.staging import release, stage


def _lowest(pairs: DataFrame, name: str) -> DataFrame:
    """The smallest ``v`` of each ``u``, written so that the join with it can be split."""
    return stage(pairs.groupBy("u").agg(F.min("v").alias("low")), name)


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links lead to, for every node but that one.

    Alternates two steps until nothing changes: every node sends its larger neighbours to
    its smallest one, then every node sends its smaller neighbours to the smallest. Paths
    shorten as by halving, so the rounds grow with the logarithm of the longest path.
    Links with a null end, and of a node with itself, lead nowhere.
    """
    both = F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))
    edges = stage(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
            F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
        ).where(both).distinct(),
        "links",
    )
    state = _state(edges)
    while state[0]:
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(ways, "links-low")
        large = stage(
            ways.join(low, "u").where(F.col("v") > F.col("u")).select(
                F.col("v").alias("u"), F.least("u", "low").alias("v")
            ).distinct(),
            "links-large",
        )
        release(low)
        low = _lowest(large, "links-low")
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u"), F.col("low").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("low").alias("v")),
                )
            ).alias("e")
        ).select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct()
        old, edges = edges, stage(small, "links-small")
        release(low, large, old)
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
