"""Connected components of links, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmith.session import materialize, release


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node that links reach) of every node in ``links``.

    Alternates two steps until nothing changes: each node's larger neighbours are linked to its
    smallest neighbour, then its smaller ones are. The number of rounds grows with the logarithm
    of the longest chain; each node's neighbours are only aggregated, never gathered. Links with
    a null end are left out; a link of a node with itself gives a component of one.
    """
    start = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    selves = start.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
    edges = materialize(start.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def step(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        joined = both.join(least, "a")
        moved = joined.where("b > a") if large else joined.where("b != m")
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    while True:
        larger = materialize(step(edges, True), "large")
        after = materialize(step(larger, False), "small")
        release(larger)
        same = (
            after.select("a", "b", F.lit(1).alias("s")).unionByName(edges.select("a", "b", F.lit(-1).alias("s"))).groupBy("a", "b").agg(F.sum("s").alias("s")).where("s != 0")
        )
        done = same.limit(1).count() == 0
        release(edges)
        edges = after
        if done:
            break
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    rest = selves.join(found.unionByName(roots).select("node"), "node", "left_anti")
    return found.unionByName(roots).unionByName(rest)
