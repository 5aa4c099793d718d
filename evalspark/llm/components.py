"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two aggregates and two joins on the node; its result is written to the shared
folder, so plans stay short and a lost executor repeats one round at most. A node with very
many edges is one key of a plain join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import written


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b): neighbours move to the smallest node around."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        m = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.filter("b > a").join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = both.filter("b < a")
        m = down.groupBy("a").agg(F.min("b").alias("m"))
        out = (down.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
               .union(m.select("a", F.col("m").alias("b"))))
    return out.filter("a <> b").distinct()


def components(spark: SparkSession, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable.

    ``edges`` has columns a and b of one type. The table after a round that changes nothing
    is a star around each root; without that after ``rounds`` rounds it raises.
    """
    e = written(spark, edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark or now[0] == 0:
            roots = e.select("b").distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
        mark = now
        e = written(spark, _star(_star(e, True), False), "edges")
    raise RuntimeError(f"components not reached in {rounds} rounds")
