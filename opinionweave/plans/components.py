"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: the root is the smallest node of its component.

    Every round links nodes to the smallest of their neighbourhood, so rounds grow with the logarithm of the edges,
    not with the size or the diameter of a component; each is written to the shared folder. Minima are combined
    before the shuffle, and joins leave a node with very many neighbours to be split. Loops are dropped.
    """
    high, low = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    state = written(edges.select(high, low).filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(first, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        state = written(small, "stars")
        seen = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = state.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
