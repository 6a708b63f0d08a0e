"""Connected components of an undirected edge list, by repeated smallest-neighbour hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.plans.session import materialise


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest node it is linked with.

    Alternates large-star and small-star steps, whose work is linear in the edges and whose groups are
    only aggregated (min), never collected, so a hub with a third of all edges stays an aggregation.
    Self loops and repeated edges do no harm; null ends are dropped.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes = e.select("u").union(e.select("v")).distinct()
    links = e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = materialise(links, "links")
    while True:
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = materialise(small, "links")
        changed = new.exceptAll(links).limit(1).count() + links.exceptAll(new).limit(1).count()
        links = new
        if not changed:
            break
    roots = links.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, "u", "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component"))
