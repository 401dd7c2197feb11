"""Connected components by contraction.

Each round gives every vertex its least neighbour as parent, follows parents to
the root, and relabels the edges; edges inside a component go. The vertices that
still have edges at least halve in a round, so a handful of rounds ends it. All
steps are joins and partial aggregates, so a hub is spread like any other key,
and each round is written to the shared folder instead of growing the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.sources.tables import cut, new_folder


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", path: str | None = None) -> DataFrame:
    """vertex, component (the least vertex reachable) for every vertex that has an
    edge. Null ends and loops are ignored; edges need not be unique or directed."""
    path = path or new_folder(edges.sparkSession, "components")
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{path}/edges-0")
    mapping, n = None, 0
    while not e.isEmpty():
        n += 1
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p")), f"{path}/tree-{n}-0")
        jump = 0
        while True:  # a parent is less than its child, so this ends at the roots
            jump += 1
            up = tree.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            tree = cut(tree.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")), f"{path}/tree-{n}-{jump}")
            if tree.where("moved").isEmpty():
                break
            tree = tree.select("v", "p")
        tree = tree.select("v", "p")
        step = tree.select(F.col("v").alias("at"), F.col("p").alias("to"))
        mapping = tree if mapping is None else mapping.join(step, mapping.p == step.at, "left").select("v", F.coalesce("to", "p").alias("p"))
        mapping = cut(mapping, f"{path}/map-{n}")
        a, b = step.toDF("a", "ra"), step.toDF("b", "rb")
        e = cut(e.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{path}/edges-{n}")
    if mapping is None:
        return e.select(F.col("a").alias("vertex"), F.col("b").alias("component")).limit(0)
    return mapping.select(F.col("v").alias("vertex"), F.col("p").alias("component"))
