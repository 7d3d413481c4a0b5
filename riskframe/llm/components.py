"""Connected components by alternating star rewrites, as Spark joins on checkpointed edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.session import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest node it sees
    (large star, small star); the edges shrink to stars in logarithmically many rounds. The driver learns
    only whether some node is still linked to two others or is an end and a middle at once.
    """
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
        e = cut_lineage(small.select("s.u", "s.v").filter("u <> v").distinct())
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("middle")).union(
            e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("middle")))
        ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("middle").alias("middle"))
        if ends.filter((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("middle") == 1))).isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
