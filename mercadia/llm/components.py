"""Connected components of a link table, by stars (large-star and small-star steps of alternating contraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercadia.llm.common import discard, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; component is the least node reachable, the node itself included.

    Each round hooks the larger neighbours of a node to its least neighbour, then its smaller ones, and writes the
    links anew, so the lineage stays short and rounds grow with the logarithm of a component's length. Least neighbours
    are found by partial aggregation, so a node with a third of all links costs one row a task. Links with a null
    end and loops are left out; an empty table gives an empty result; repeated links count once.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high.alias("u"), low.alias("v")).distinct()
    edges = materialize(edges)
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        last, edges = edges, materialize(_small_star(_large_star(edges)))
        discard(last)
    roots = edges.groupBy("v").agg(F.count("*").alias("n")).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours get a link to its least neighbour, or to itself if it is less."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u_"), F.least("u", "m").alias("m"))
    larger = both.where("v > u")
    return larger.join(least, F.col("u") == F.col("u_")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours get a link to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    smaller = edges.join(least.withColumnRenamed("u", "u_"), F.col("u") == F.col("u_")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(smaller).distinct()
