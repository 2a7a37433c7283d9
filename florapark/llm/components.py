"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from florapark.llm._store import drop, pin


def connected(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable from each id of ``links`` (a, b: long); ids without a link do not appear.

    Large-star then small-star, until nothing changes. Each round is an aggregate and
    a join on the node, so a node with very many links is combined before it is
    shuffled and a large partition of the join can be split.
    """
    edges = pin(links.where(F.col("a") != F.col("b"))
                .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        star = pin(_small_star(_large_star(edges)))
        drop(edges)
        edges = star
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
                          ).first()
        now = (state["n"], state["h"])
        if now == seen:
            break
        seen = now
    # every node now hangs on the smallest of its component
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))  # u < v
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .where(F.col("u") != F.col("v")).distinct()
    )
