"""Connected components of a graph that is never collected."""

from __future__ import annotations

from itertools import cycle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.session import scratch_path


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``a, b`` (long); a component is named by its smallest node.

    Rounds of large stars and small stars: every node hands its larger, then its smaller
    neighbours the smallest one it knows, until the graph is a forest of stars. The number
    of rounds grows with the logarithm of the longest path. A neighbourhood is never gathered:
    it meets in a minimum with map-side combine and in an equi-join whose large partitions
    adaptive execution splits. Each round is written to the shared folder, over the one before the last. Edges with a null end and loops name no link;
    the ends of a loop are nodes. Repeated edges count once. No edges give an empty frame.
    """
    links = edges.where("a IS NOT NULL AND b IS NOT NULL").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    paths = cycle([scratch_path(edges.sparkSession, "links") for _ in range(2)])
    links = _rewritten(links.distinct(), next(paths))
    state = None
    while True:
        links = _rewritten(_small_star(_large_star(links)), next(paths))
        summary = links.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if summary == state:
            break
        state = summary
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    ).groupBy("node").agg(F.min("component").alias("component"))


def _rewritten(links: DataFrame, path: str) -> DataFrame:
    links.write.mode("overwrite").parquet(path)
    return links.sparkSession.read.schema(links.schema).parquet(path)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(
        links.select(F.col("v").alias("node"), F.col("u").alias("other"))
    )
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    return both.join(least, "node").where("other > node").select(
        F.col("other").alias("u"), F.col("least").alias("v")
    ).unionByName(links.where("u = v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
    handed = links.select(F.col("u").alias("node"), F.col("v").alias("other")).join(least, "node")
    return handed.select(F.col("other").alias("u"), F.col("least").alias("v")).where("u > v").unionByName(
        least.select(F.col("node").alias("u"), F.col("least").alias("v"))
    ).distinct()
