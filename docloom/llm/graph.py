"""Connected components of a graph given as a table of edges, without collecting any of it.

Alternating large-star and small-star steps (Kiveris et al., 2014): each is an
aggregation for the smallest neighbour and a join back. A node with very many
neighbours is one key of an aggregation that sums up before the shuffle, and of
a join whose large side can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import forget, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("u"))
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge (a, b) that is not its component's smallest; root is the smallest."""
    now = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = None
    while True:
        step = _stars(_stars(now, True), False)
        following = written(step, "edges")
        forget(now)
        now = following
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)
