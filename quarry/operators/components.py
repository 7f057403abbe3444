"""Connected components by alternating large and small stars.

Every round hangs the larger neighbours of each node on the smallest node it
knows, then the smaller ones, so components become stars around their
smallest node in a number of rounds that grows with the logarithm of their
size, also for long chains. A round is two grouped minimums (partial
aggregation) and two joins on the node, which Spark can split when a star
centre is hot; no neighbourhood is collected. Each round's edges are written
to the shared folder, and those of the round before are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import discard, stored


def _star(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs(u, v) with the smallest of u and its v as ``m``, the stored
    minimums): read back, they are broadcast if small, and else joined on plain
    shuffles, which Spark splits where one node has many pairs."""
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")), "component-minimums")
    return pairs.join(least, "u").withColumn("m", F.least("u", "m")), least


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) for every node of an edge between different nodes; the
    label is the smallest node of its component. Nodes may be of any type
    that orders; edges with a null end are ignored."""
    u, v = F.col(a), F.col(b)
    current = stored(edges.filter(u != v).select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).distinct(),
                     "component-edges")
    mark = None
    while True:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large, least_of_all = _star(both)
        large = large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small, least = _star(large.filter("u > v").distinct())
        joined = small.select(F.col("u").alias("a"), F.col("m").alias("b")).unionByName(
            small.filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")))
        last, current = current, stored(joined.distinct(), "component-edges")
        discard(last, least_of_all, least)
        now = tuple(current.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a))")).first())
        if now == mark:
            return current.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(
                current.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
        mark = now
