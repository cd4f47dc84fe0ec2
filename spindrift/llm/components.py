"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import pinned, release


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r.n, r.x


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node with an edge; `edges` has long a and b.

    Each round joins a node's edges with the least of its neighbours; nodes with very many edges are
    split by Spark's skew join. The number of rounds grows with the logarithm of the longest path.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = pinned(e)
    before = _state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = pinned(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        starred = large.join(least, "a")
        small = starred.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(starred.select("a", F.col("m").alias("b"))).distinct()
        small = pinned(small)
        release(large)
        release(e)
        e, after = small, _state(small)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    leaves = e.groupBy("a").agg(F.min("b").alias("b"))
    return leaves.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
