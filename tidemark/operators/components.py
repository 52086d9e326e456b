"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import intermediates, kept, materialise

MAX_ROUNDS = 60


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``links`` (a, b: long) -> (node, root), one row for each node that has a link;
    root is the smallest node reachable.

    Every round rewires the links (each node's larger neighbours, then its smaller ones,
    to the least neighbour) and writes them to the shared folder; it ends when each
    node but the roots has one link, to a root. Rows stay below the number of links; a node with very many
    links is joined, not gathered, so adaptive execution can split it. Links with null
    and loops are left out.
    """
    spark = links.sparkSession
    edges = materialise(
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    for _ in range(MAX_ROUNDS):
        edges = _round(spark, edges)
        if _are_stars(edges):
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v"), F.col("v")).distinct()
    )


def _round(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """One round; what it writes on the way is deleted."""
    with intermediates(spark):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "large-star")
        larger = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(larger.distinct(), "links")
        m = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(m, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        out = small.filter("u <> v").distinct()
        return kept(out, "links")


def _are_stars(edges: DataFrame) -> bool:
    roots = edges.select(F.col("v").alias("u")).distinct()
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
    return edges.select("u").join(roots, "u", "left_semi").union(twice).isEmpty()
