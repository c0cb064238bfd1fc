"""Connected components of large graphs, by Spark jobs alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, gathered, lookup


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every end of an edge, root being the smallest node of its component.

    Alternating large-star and small-star contractions: each round is two grouped minima, edges never outnumber the input's, and
    rounds grow with the logarithm of a component's width. Each round is cut by a checkpoint; a node with many edges meets its minimum
    by a broadcast. Self-loops and null ends are ignored.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    signature = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if tuple(found) == signature:
            break
        signature = tuple(found)
        rows = found[0]
        now = gathered(now, rows)
        both = gathered(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), rows)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(gathered(lookup(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), rows))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup(large, least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut(gathered(small.where("u > v").distinct(), rows))
    return gathered(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), found[0])
