"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch


def _reshuffled(column, kind):
    """The same value under an expression that no earlier partitioning covers, so that a join deals out both sides and AQE may split a hot key."""
    return F.concat(column, F.lit("")) if isinstance(kind, T.StringType) else column.bitwiseXOR(F.lit(0).cast(kind))


def _smaller(edges: DataFrame, kind, node: str, least: str) -> DataFrame:
    """The least smaller neighbour of each node that has one; aggregated on the map side first."""
    return edges.groupBy("u").agg(F.min("v").alias(least)).select(_reshuffled(F.col("u"), kind).alias(node), least)


def connected_components(edges: DataFrame, scratch: Scratch, left: str = "a", right: str = "b") -> DataFrame:
    """Returns (node, component): every node of the edges with the smallest node that it reaches.

    Nodes are integers or strings. Null ends and loops are left out; repeated and reversed edges count once;
    an empty table gives an empty one. All work is joins and map-side combined minima on edges: a node with very many
    edges is one key of joins that AQE can split, and neither edges nor components reach the driver.
    The number of rounds grows with the logarithm of the longest path.
    """
    kind = edges.schema[left].dataType
    a, b = F.col(left), F.col(right)
    e = scratch.keep(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )

    def state(table: DataFrame):
        row = table.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = state(e)
    while before[0]:
        near = _smaller(e, kind, "x", "m")
        large = scratch.keep(
            e.join(near, e.v == near.x, "left").select(e.u, F.coalesce(F.col("m"), e.v).alias("v")).distinct(), "large"
        )
        least = _smaller(large, kind, "x", "m")
        pairs = large.join(least, large.u == least.x).select(large.u, large.v, "m")
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = scratch.keep(pairs.select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u != v").distinct(), "small")
        scratch.drop(e)
        scratch.drop(large)
        e, now = small, state(small)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
