"""Connected components of a table of edges, by contraction along least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def _roots(edges: DataFrame) -> DataFrame:
    """(a, up): each end of the edges, which go both ways, and the root of its tree of least neighbours.

    Two ids that are each other's least neighbour are the only cycles there can be; the lesser is the root.
    Pointers jump until they rest, so a tree of depth d takes about log2(d) jumps.
    """
    near = edges.groupBy("a").agg(F.min("b").alias("up"))
    back = near.select(F.col("a").alias("via"), F.col("up").alias("back"))
    is_root = (F.col("back") == F.col("a")) & (F.col("a") < F.col("up"))
    tree = materialize(near.join(back, F.col("up") == F.col("via")).select("a", F.when(is_root, F.col("a")).otherwise(F.col("up")).alias("up")), "tree")
    while True:
        jump = tree.select(F.col("a").alias("via"), F.col("up").alias("far"))
        tree = materialize(tree.join(jump, F.col("up") == F.col("via")).select("a", F.col("far").alias("up"), F.col("up").alias("was")), "tree")
        if tree.where("up <> was").isEmpty():
            return tree.select("a", "up")
        tree = tree.select("a", "up")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) of every id with an edge (a, b) to another: the label is the least id of the component.

    Each round every id joins its least neighbour, and the trees so made become the ids of the next round.
    A tree has two ids or more, so a component of n ids takes at most log2(n) rounds, whatever its
    shape. Rounds end when no edge is left; labels never leave the executors.
    """
    both = edges.where("a <> b").select("a", "b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = None
    while labels is None or not both.isEmpty():
        up = _roots(both)
        if labels is None:
            labels = up.select(F.col("a").alias("id"), F.col("up").alias("label"))
        else:
            labels = labels.join(up, F.col("label") == F.col("a"), "left").select("id", F.coalesce("up", "label").alias("label"))
            labels = materialize(labels, "labels")
        ends = both.join(up.withColumnRenamed("up", "from"), "a").join(up.select(F.col("a").alias("b"), F.col("up").alias("to")), "b")
        both = materialize(ends.where(F.col("from") != F.col("to")).select(F.col("from").alias("a"), F.col("to").alias("b")).distinct(), "edges")
    least = labels.groupBy("label").agg(F.min("id").alias("least"))
    return materialize(labels.join(least, "label").select("id", F.col("least").alias("label")), "labels")
