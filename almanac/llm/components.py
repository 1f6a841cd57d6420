"""Connected components of an edge table, by contraction.

Each round every node takes the smallest of itself and its neighbours as parent,
parents are followed one step further, and edges are redrawn between parents;
edges within one parent disappear. The smallest node of a component never moves,
so when no edge is left it is every member's label. A hub's neighbours only ever
meet in a map-side combined minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (columns a and b); component is the smallest node."""
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .distinct(), "edges")
    labels = None
    while labels is None or not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select(
            "node", F.least("node", "p").alias("p"))
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        parent = written(parent.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p")), "parents")
        pa, pb = (parent.select(F.col("node").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        e = written(e.join(pa, "a").join(pb, "b").where("pa <> pb")
                    .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        if labels is None:
            labels = parent.select("node", F.col("p").alias("component"))
        else:
            labels = labels.join(parent.withColumnRenamed("node", "component"), "component", "left").select(
                "node", F.coalesce("p", "component").alias("component"))
    return written(labels, "components")
