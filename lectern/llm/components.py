"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge, roots left out; root is the smallest node reachable.

    `edges` has two columns of one ordered type; loops and repeats are ignored. All rounds are
    joins and grouped minima over edges: nothing is collected but a count and a checksum of the
    edge set, which stop changing when every node points at its root.
    """
    a, b = (F.col(c) for c in edges.columns)
    now = written(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = mark
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
        before, now = now, written(small.where("hi <> lo").distinct(), "edges")
        forget(before)
