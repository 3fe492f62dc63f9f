"""Connected components of links between integer nodes, for the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitspark.operators.keys import per_key
from transitspark.session import Rounds


def roots(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link in `links` (a, b); the root is the component's smallest node.

    Every node points to the smallest node it knows and hands that to all it knows, itself included; links that point
    to a root stay, the others move up. A hub costs its links, never pairs of them, and rounds grow with the
    logarithm of the size. Each round is a written table. Nulls link nothing; repeated links and loops change nothing.
    """
    up = links.filter("a != b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).distinct()
    shape = {"links": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))}
    rounds = Rounds(links.sparkSession, "roots")
    now, seen = rounds.keep(up, **shape)
    before = None
    while seen["links"] and seen != before:
        least = per_key(now, ["node"], F.min("to").alias("least"))
        # whoever points to a node that points on itself points to that one's target
        moved = now.join(least.select(F.col("node").alias("to"), F.col("least").alias("onward")), "to", "left")
        moved = moved.select("node", F.coalesce("onward", "to").alias("to")).distinct()
        least = per_key(moved, ["node"], F.min("to").alias("least"))
        # a node's other targets now point to its smallest
        ends = F.array(F.struct(F.col("node"), F.col("least").alias("to")), F.struct(F.col("to").alias("node"), F.col("least").alias("to")))
        spread = moved.join(least, "node").select(F.explode(ends).alias("p")).select("p.*")
        before = seen
        now, seen = rounds.keep(spread.filter("node != to").distinct(), **shape)
    pointed = now.groupBy("node").agg(F.min("to").alias("root"))
    return pointed.unionByName(pointed.select(F.col("root").alias("node"), "root").distinct())
