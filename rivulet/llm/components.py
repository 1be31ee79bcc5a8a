"""Connected components of links that never leave the cluster, and bounded blocks of large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of the links a, b, by alternating large and small stars.

    Each round replaces edges by edges to smaller nodes and is written to the shared folder, where it takes the place of the
    round before; the number of rounds grows with the logarithm of the longest chain. Only the count and a checksum of the
    edges come to the driver. Links of a node to itself and null ends are ignored; repeats are merged; without links there
    are no rows. Nodes are of any type that has an order.
    """
    edges = durable(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == sign or now[0] == 0:
            break
        sign = tuple(now)
        # Large star: every larger neighbour of a node moves to the node's smallest neighbour (or to itself).
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Small star: a node's smaller neighbours, and the node, move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(least, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = durable(small.where("a != b").distinct(), replaces=edges)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def blocks(members: DataFrame, key: str, node: str, size: int, weight=None) -> DataFrame:
    """Members of groups, dealt into pairs of blocks of about `size` (members, or the sum of their weights), so that no task
    holds a whole large group.

    Adds i, j (the pair of blocks, i <= j) and block (the member's own). All pairs of members meet in exactly one (key, i, j):
    members of one block in (i, i), others where both their blocks are.
    """
    counts = members.groupBy(key).agg(F.ceil(F.sum(F.lit(1) if weight is None else weight) / size).cast("int").alias("parts"))
    dealt = members.join(counts, key).withColumn("block", F.expr(f"pmod(xxhash64({node}), parts)").cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "parts")
