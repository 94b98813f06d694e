"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialize


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(v, component)`` for each vertex of ``edges(a, b)``; a component is named by its least vertex.

    Each round takes the least name among a vertex and its neighbours and then the name of that name, so that names
    travel twice as far each round. Both steps are equi-joins with map-side combining, so a vertex of high degree is
    no bottleneck. Every round is a written table, which bounds lineage. Self loops and repeated edges are harmless.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct(), f"{label}-edges")
    names = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("component")), f"{label}-names")
    while True:
        near = both.join(names, both.b == names.v).groupBy("a").agg(F.min("component").alias("_near"))
        stepped = names.join(near, names.v == near.a).select("v", F.least("component", "_near").alias("_c"), F.col("component").alias("_old"))
        far = names.select(F.col("v").alias("_v"), F.col("component").alias("_far"))
        after = stepped.join(far, stepped._c == far._v, "left").select("v", F.least("_c", F.coalesce("_far", "_c")).alias("component"), "_old")
        after = materialize(after, f"{label}-names")
        if after.where("component <> _old").isEmpty():
            return after.select("v", "component")
        names = after.select("v", "component")
