"""Connected components by alternating large-star and small-star steps.

Edges shrink towards stars around the smallest node of each component; every
step is a grouped minimum (partially aggregated, so a hub costs one row per
map task) and an equi-join that adaptive execution can split when a hub is
hot. Nothing is collected but a yes or no per round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caisse.llm.common import cut

#: Rounds after which a graph that still changes raises an error; stars over n nodes need about log2(n).
MAX_ROUNDS = 64


def _both(edges: DataFrame, back: Column) -> DataFrame:
    """Edges (u, v) and, from the same scan, the ends v with ``back``."""
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), back.alias("v")))
    return edges.select(F.explode(ends).alias("e")).select("e.*")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: every u has one v, and no v is a u."""
    ends = _both(edges, F.lit(None).cast("long"))
    seen = ends.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"), F.count("v").alias("up"))
    return seen.filter("lo <> hi or (up > 0 and up < n)").limit(1).count() == 0


def _members(stars: DataFrame) -> DataFrame:
    """(node, component) of the leaves and the centres of stars."""
    centres = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres)


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v) of the nodes of ``edges`` (a, b) that are not the smallest of their component, which is v."""
    ab = edges.select("a", "b").filter("a <> b")
    # Invariant: u > v.
    cur = cut(ab.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        if _settled(cur):
            return cur
        # Large star: every larger neighbour of u moves to the smallest node around u.
        both = _both(cur, F.col("u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u and its smaller neighbours move to the smallest of them; u itself by the edge to that one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.expr("if(v > m, v, u)").alias("u"), F.col("m").alias("v"))
        cur = cut(small.distinct())
    raise RuntimeError("components did not settle")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge; component is the smallest node reachable.

    ``edges`` has the long columns a and b. Nulls and loops are ignored,
    repeated and reversed edges count once; no edges give an empty table.
    """
    return _members(_stars(edges))


def with_component(nodes: DataFrame, col: str, edges: DataFrame) -> DataFrame:
    """``nodes`` with the column component: the smallest node that ``col`` reaches by ``edges``, itself where there is none.

    A null stays null. Only the nodes that move are joined: the smallest one
    of a component needs no row.
    """
    found = _stars(edges).toDF("__node", "__low")
    return nodes.join(found, nodes[col] == found["__node"], "left").withColumn("component", F.coalesce("__low", col)).drop("__node", "__low")
