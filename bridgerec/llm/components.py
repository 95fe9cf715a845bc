"""Connected components of an edge table by alternating large and small stars
(Kiveris et al., Connected Components in MapReduce and Beyond, 2014).

Every round replaces the edges by shorter ones that keep the components; the
edge count never grows, and a table is written to the shared folder after each
round.  A node's minimum is one pre-aggregated value, so a hub with very many
edges sends one row a task to its aggregate; the join that hands the minimum
back is an equi-join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bridgerec.llm.staging import Stage

#: Rounds grow with the logarithm of the longest chain; more than this means a fault.
MAX_ROUNDS = 60


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v."""
    if larger:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if larger:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").dropDuplicates(["u", "v"])


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v), u > v, are stars already: a node with an edge down has no other edge."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionAll(edges.select("v", F.lit(0)))
    met = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("n"))
    return met.filter("down > 0 and n > 1").isEmpty()


def connected_components(edges: DataFrame, stage: Stage, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node that has an edge in ``edges(a, b)``;
    the component is its smallest node.  Self-loops, nulls and repeats are ignored."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stage.write(now.filter("u != v").dropDuplicates(["u", "v"]), f"{name}-0")

    for k in range(MAX_ROUNDS + 1):
        if _settled(now):
            least = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return least.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        now = stage.write(_stars(_stars(now, True), False), f"{name}-{k + 1}")
        stage.drop(f"{name}-{k}")
    raise RuntimeError("components did not settle")


def merged_components(found: DataFrame, links: DataFrame, stage: Stage, name: str) -> DataFrame:
    """``found(node, component)`` after more ``links(a, b)``, the same as :func:`connected_components` of all
    links: only the components that the new ones join are gone through.  Both frames are read
    repeatedly, so they should be written ones."""
    if links.isEmpty():
        return found
    ends = links.join(found.toDF("a", "_a"), "a", "left").join(found.toDF("b", "_b"), "b", "left")
    joined = connected_components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")), stage, name)
    moved = found.join(joined.toDF("component", "_to"), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return moved.unionAll(joined.join(found, "node", "left_anti"))
