"""Connected components by alternating large and small stars (Kiveris and others, 2014).

A round aggregates each node's least neighbour and joins it back to the node's edges. The edges of a node with more than ``HUB`` of
them don't gather in one task: such hubs are few (edges over ``HUB`` at most), so how many parts each needs is sent to the edges. Lineage
is cut by writing the edges of each round. Rounds go on until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triscope.sources.scratch import written

#: Edges of a node that one task takes.
HUB = 1_000_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(around: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """Each edge with the least neighbour of its ``u``; the edges of a hub in as many parts as it has ``hub`` edges."""
    parts = F.ceil(F.col("n") / hub).cast("int")
    hubs = F.broadcast(least.where(F.col("n") > hub).select("u", parts.alias("parts")))
    part = F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1)).cast("bigint")).cast("int")
    filed = least.select("u", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return around.join(hubs, "u", "left").withColumn("part", part).drop("parts").join(filed, ["u", "part"]).drop("part")


def _star(edges: DataFrame, large: bool, hub: int) -> DataFrame:
    """Large star: each node's larger neighbours to its least neighbour; small star: its smaller ones and itself."""
    around = _both_ways(edges)
    if not large:
        around = around.where("v <= u")
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    joined = _with_least(around, least, hub)
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int | None = None, hub: int = HUB) -> DataFrame:
    """node, component (its least node) of all nodes of ``edges`` (u, v). Self-loops give nodes of their own; nulls fall away.

    With ``rounds`` an error is raised if so many don't suffice: an unfinished result is never given.
    """
    clean = edges.where("u is not null and v is not null").select("u", "v")
    nodes = clean.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = written(clean.where("u <> v").distinct(), "edges")
    before: tuple | None = None
    done = 0
    while True:
        now = written(_star(_star(now, True, hub), False, hub), "edges")
        mark = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if mark == before:
            break
        before, done = mark, done + 1
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"components not found within {rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))
