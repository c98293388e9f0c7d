"""Connected components of an undirected graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickplane.tables import stage, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step on edges (u, v) with u > v.

    A node's neighbours are hung on the least of them.  The minimum is a
    pre-aggregated sum per node and the edges meet it in an inner join, whose
    skewed partitions Spark can split; no neighbour list is ever gathered.
    """
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = seen.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable, for every linked node.

    Self links, repeated links and either direction are allowed; rows with a
    null end are ignored; no links give no rows.  Each round halves the depth of
    what is left, and rounds are staged tables, so lineage stays short.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).where(F.col(a) != F.col(b))
    edges = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        after = stage(_star(_star(edges, True), False), "edges")
        unstage(edges)
        edges = after
        # The edge set is stable once every edge hangs a node on a root.
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
