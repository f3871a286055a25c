"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstone.llm.common import empty, stash


def _jump(parent: DataFrame) -> DataFrame:
    """Pointers (x, p) made to point to their roots; p is smaller than x, so there are no cycles."""
    while True:
        far = parent.join(parent.select(F.col("x").alias("p"), F.col("p").alias("q")), "p", "left")
        parent = stash(far.select("x", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "pointers")
        if empty(parent.where("moved")):
            return parent.select("x", "p")
        parent = parent.select("x", "p")


def _relabel(df: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    to = parent.select(F.col("x").alias(column), F.col("p").alias("_root"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")


def components(edges: DataFrame) -> DataFrame | None:
    """(x, root) of every node of ``edges`` (a, b) that is not its component's smallest; None without edges.

    Each node points to its smallest smaller neighbour, pointers are doubled up to their roots, the
    edges are drawn between the roots, and so on until no edge is left.
    """
    edges = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    label = None
    while not empty(edges):
        parent = _jump(stash(edges.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("p")), "parents"))
        if label is None:
            label = parent
        else:
            label = stash(_relabel(label.withColumnRenamed("p", "root"), parent, "root").withColumnRenamed("root", "p").unionByName(parent), "labels")
        moved = _relabel(_relabel(edges, parent, "a"), parent, "b").where("a <> b")
        edges = stash(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return None if label is None else label.select("x", F.col("p").alias("root"))
