"""Connected components by alternating large and small stars.

Every step is a join and an aggregation over the edge table, which is written
below ``spark.checkpoint.dir`` after each round. A star's centre may have any
number of edges: minima are pre-aggregated, and the join against them deals
the edges of a node over ``SALTS`` shares.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusvitals.session import stage

SALTS = 16


def _with_minimum(edges: DataFrame, minima: DataFrame, node: str) -> DataFrame:
    """``edges`` with ``m`` of their end ``node``; ``minima(node, m)`` has a row per node."""
    other = "low" if node == "high" else "high"
    dealt = edges.withColumn("share", F.pmod(F.hash(other), F.lit(SALTS)))
    shares = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("share")
    return dealt.join(minima.select(F.col("node").alias(node), "m", shares), [node, "share"])


def _state(edges: DataFrame) -> tuple:
    mark = F.xxhash64("high", "low").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mark)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(high, low)``; the root is the smallest node reachable."""
    edges = stage(edges.filter("high <> low").select(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.select(F.col("high").alias("node"), F.col("low").alias("next")).union(edges.select("low", "high"))
        least = both.groupBy("node").agg(F.min("next").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = _with_minimum(edges, least, "low").select("high", F.col("m").alias("low")).distinct()
        lowest = large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("m"))
        small = (
            _with_minimum(large, lowest, "high")
            .select(F.explode(F.array(F.struct("high", "m"), F.struct(F.col("low").alias("high"), "m"))).alias("e"))
            .select("e.high", F.col("e.m").alias("low"))
            .filter("high <> low")
            .distinct()
        )
        edges = stage(small, "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
        edges.select(F.col("low"), F.col("low")).distinct()
    )
