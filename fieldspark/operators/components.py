"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """One row per vertex that an edge touches: id, component (the smallest id that it is connected to).

    Alternating large-star and small-star steps (Kiveris et al. 2014): each round is two aggregations and two joins over
    at most as many rows as there are edges, written to the shared folder, so plans stay short. The number of rounds grows
    with the logarithm of the longest path; a RuntimeError is raised if `max_rounds` don't suffice. Null ends, loops and
    repeated edges are ignored.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of u hangs on the smallest of u and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        e = materialise(e, "large-star")
        # Small star: u and its smaller neighbours hang on the smallest of them.
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        own = low.select("u", F.col("m").alias("v"))
        e = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(own).distinct()
        e = materialise(e, "small-star")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = e.select(F.col("v").alias("id")).distinct()
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("id")))
        before = now
    raise RuntimeError(f"components didn't settle within {max_rounds} rounds")
