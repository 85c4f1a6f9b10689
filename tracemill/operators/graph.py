"""Graph operators over node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialized


def in_degree(edges: DataFrame, target: str = "dst") -> DataFrame:
    return edges.groupBy(target).agg(F.count(F.lit(1)).alias("in_degree"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node and its distance from the seeds (a column `node`), up to depth, along edges in either direction.

    One join a level on the frontier only, and each frontier is written, so a level reads the ones
    before it and does not compute them again; a level without new nodes is the last.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = materialized(seeds.select("node").distinct().withColumn("distance", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(both, front["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        front = materialized(step.join(seen, "node", "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (a column `node`) that no edge from another node reaches."""
    reached = edges.filter("src <> dst").select(F.col("dst").alias("node"))
    return nodes.join(reached, "node", "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target is not a node."""
    return edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti")


def _tangled(now: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or smaller and larger ones: edges lo, hi are not yet stars around their roots."""
    ends = now.select(F.explode(F.array(F.struct(F.col("lo").alias("n"), F.lit(0).alias("up")), F.struct(F.col("hi").alias("n"), F.lit(1).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("n").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("all")).filter("ups > 0 AND all > 1").agg(F.count(F.lit(1))).first()[0] > 0


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node on an edge (u, v), by alternating star contraction.

    Every node's larger neighbours move to its smallest one, then every node and its smaller neighbours to
    the smallest of them; the rounds grow with the logarithm of the nodes and each is written. What is
    already stars around smallest nodes takes no round.
    """
    now = materialized(edges.filter("u <> v").select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct())
    while _tangled(now):
        both = now.select(F.explode(F.array(F.struct(F.col("lo").alias("n"), F.col("hi").alias("m")), F.struct(F.col("hi").alias("n"), F.col("lo").alias("m")))).alias("e")).select("e.*")
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("to"))
        up = now.join(least, now["lo"] == least["n"]).select(F.col("to").alias("lo"), "hi").repartition("hi")  # dealt once for both uses
        low = up.groupBy("hi").agg(F.min("lo").alias("to"))
        moved = F.array_compact(F.array(F.struct("to", F.col("hi").alias("n")), F.when(F.col("lo") != F.col("to"), F.struct("to", F.col("lo").alias("n")))))
        now = materialized(up.join(low, "hi").select(F.explode(moved).alias("e")).select(F.col("e.to").alias("lo"), F.col("e.n").alias("hi")).distinct())
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def merged(roots: DataFrame | None, edges: DataFrame) -> DataFrame:
    """node, root after more edges (u, v): only the new ones are contracted, between the roots of before."""
    if roots is None:
        return materialized(components(edges))
    for c in "uv":
        edges = edges.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    step = components(edges.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")))
    moved = roots.join(step.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialized(moved.unionByName(step.join(roots, "node", "left_anti")))
