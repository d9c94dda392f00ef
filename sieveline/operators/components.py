"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any ordered type -> (node, root), root the least node of its component; isolated nodes and
    loops are left out.

    Alternating large and small stars: rounds grow with the logarithm of the diameter. Every round is written to the
    checkpoint folder, so its lineage is short and it outlives executors; rounds end when one changes nothing."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    w, state = Window.partitionBy("u"), None
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.withColumn("m", F.least(F.col("u"), F.min("v").over(w)))
        large = least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        linked = large.withColumn("m", F.min("v").over(w))
        small = linked.select("u", F.col("m").alias("v")).union(linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = cut(small.distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
