"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.store import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours hang on the least id around each node."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = both.filter("b < a")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) edges -> (node, component): the least node reachable.

    Only nodes with an edge appear; self-loops are ignored. Each round is a
    few shuffles of the edge table and is written to the shared folder, so a
    lost executor costs one round. Stops when only stars are left.
    """
    cur = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    while True:
        cur = materialize(_star(_star(cur, True), False), "star")
        # Done when the graph is a set of stars: every leaf has one edge, no centre is a leaf.
        ends = cur.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("leaf")), F.struct(F.col("b").alias("node"), F.lit(0).alias("leaf")))).alias("e")).select("e.*")
        per_node = ends.groupBy("node").agg(F.sum("leaf").alias("up"), F.count("*").alias("n"))
        if per_node.filter("up > 1 or (up = 1 and n > 1)").isEmpty():
            break
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
