"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``component``): for each end of the edges (``a``, ``b``), the smallest node that it is connected with.

    Steps end when no edge changes, after about log(n) of them. Each is an aggregation by node, summed before the
    shuffle, and a join that Spark can split at hot nodes; no node's edges are ever gathered.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        # large star: a node's larger neighbours go to its smallest one
        wide = both(edges)
        least = wide.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = wide.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == now:
            break
        state = now
    rows = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return rows.unionByName(rows.select(F.col("component").alias("node"), "component").distinct())
