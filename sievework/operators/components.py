"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import dropped, written


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every end of ``edges`` (``a, b``), the component named by its least id.

    Alternates the large-star and small-star steps, whose edges end in stars after a number of
    rounds that grows with the logarithm of the longest path; each round is written to the shared
    folder, so lineage stays short. Edges with a null end, loops and repeated edges are ignored, but
    a loop's node is returned. Nothing but two numbers a round reaches the driver.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).where("id is not null").distinct()
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:  # ends: every round that changes an edge moves it to a lesser id
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, now = now, written(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(before)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == last:
            break
        last = tuple(sums)
    label = now.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(label, nodes.id == label.u, "left").select("id", F.coalesce("component", "id").alias("component"))
