"""Connected components of an undirected graph by alternating star contraction.

Every round is two aggregations and two joins on node ids, so a hub is pre-aggregated before its
shuffle and its join partition may be split by adaptive execution. No group is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, both: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the least node in reach: larger neighbours, or the node and smaller ones."""
    side = both if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = side.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    joined = side.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u <> m").select("u", F.col("m").alias("v")))
    return out.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; ``root`` is the least node of its component.

    Self loops and nulls are ignored; an empty graph gives an empty table. Raises if ``rounds``
    double steps do not converge (the number needed is logarithmic in the diameter).
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = _star(e, both, large=True)
        e = cut(_star(big, None, large=False))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v")).distinct()
        mark = now
    raise RuntimeError("components did not converge")
