"""Connected components of an edge table, in rounds of joins on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantframe.session import stage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """One row per node that has an edge: ``node`` and ``root``, the smallest node reachable from it.

    Alternates two steps: every node's larger neighbours go to its smallest neighbour, then every node and its
    smaller neighbours do. Each round is written to the shared folder, so that lineage stays short. Edges with a null
    end are left out; an empty table gives an empty result.
    """
    ends = edges.filter(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}")
    now = stage(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = stage(small.filter("u <> v").distinct(), "edges")
