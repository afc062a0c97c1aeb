"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm import common


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``label``, the smallest node that it is connected to, for every node of an edge.

    Alternating star steps: each node hooks its larger neighbours, then its smaller ones, to the
    smallest node near it. The number of rounds grows with the logarithm of the graph, not with its
    diameter. A node of a third of all edges is one partial minimum per task and a join that Spark
    can split. Each round is written to the shared folder. Null nodes and loops are left out.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b))
    pairs = common.written(pairs.distinct(), "edges")

    def hooked(pairs: DataFrame, larger: bool) -> DataFrame:
        flipped = pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))
        near = pairs.unionByName(flipped) if larger else pairs
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = near.join(common.merged(least), "u")
        if larger:
            joined = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            same = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            joined = same.unionByName(least.select("u", F.col("m").alias("v")))
        return joined.where("u <> v").distinct()

    if pairs.isEmpty():
        return spark.createDataFrame([], "node long, label long")
    before = None
    while True:
        pairs = common.written(hooked(hooked(pairs, True), False), "edges")
        sums = pairs.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
