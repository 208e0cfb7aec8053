"""Connected components over an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _smallest(neighbours: DataFrame) -> DataFrame:
    """(node, m): the smallest of a node and its neighbours; partial minima are combined before the shuffle, so a hub costs one row a task."""
    return neighbours.groupBy("node").agg(F.min("nbr").alias("least_nbr")).select("node", F.least("node", "least_nbr").alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in an edge; component is the smallest node reachable.

    Nodes are of any ordered type. A struct that begins with a document's id makes the component carry that id, so no
    join on the component, which one group may dominate, has to look it up.

    Edges may repeat, run either way, or join a node to itself; nulls are ignored. An empty table gives an empty table.
    Each round is two joins on the node; hot nodes are split by the adaptive skew join, and rounds are written to the
    shared folder, so the driver sees only two numbers a round.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi is not null and lo is not null")
    now = stored(pairs.where("hi <> lo").distinct(), "edges")
    before = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.select(F.col("hi").alias("node"), F.col("lo").alias("nbr")).unionByName(now.select(F.col("lo").alias("node"), F.col("hi").alias("nbr")))
        large = both.join(_smallest(both), "node").where("nbr > node").select(F.col("nbr").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        down = large.select(F.col("hi").alias("node"), F.col("lo").alias("nbr"))
        least = _smallest(down)
        small = down.join(least, "node").select(F.col("nbr").alias("hi"), F.col("m").alias("lo")).unionByName(least.select(F.col("node").alias("hi"), F.col("m").alias("lo")))
        now = stored(small.where("hi <> lo").distinct(), "edges")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
