"""Connected components by contraction, as DataFrame joins that no vertex's degree can overload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _forest(edges: DataFrame) -> DataFrame:
    """Point every vertex with a smaller neighbour to its smallest one, then to that tree's root: columns hi, root."""
    tree = materialize(edges.groupBy("hi").agg(F.min("lo").alias("root")), "components-tree")
    while True:
        up = tree.select(F.col("hi").alias("root"), F.col("root").alias("higher"))
        jumped = materialize(tree.join(up, "root", "left").select("hi", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "components-tree")
        tree = jumped.select("hi", "root")
        if jumped.where("moved").isEmpty():
            return tree


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that a vertex of edges reaches, for the vertices that reach a smaller one.

    Loops and repeated edges are harmless; edges with a null end are ignored. No edges give no rows.
    """
    pair = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).toDF("lo", "hi", "real")
    left = materialize(pair.where("real").select("lo", "hi").distinct(), "components-edges")
    labels = None
    while not left.isEmpty():
        tree = _forest(left)
        if labels is None:
            labels = tree.toDF("id", "component")
        else:
            moved = labels.join(tree.toDF("component", "root"), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
            labels = materialize(moved.unionByName(tree.toDF("id", "component")), "components-labels")
        ends = left.join(tree.toDF("hi", "top"), "hi").join(tree.toDF("lo", "low_root"), "lo", "left").select(F.coalesce("low_root", "lo").alias("x"), F.col("top").alias("y"))
        left = materialize(ends.where("x <> y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(), "components-edges")
    if labels is None:
        labels = left.toDF("id", "component")
    return labels
