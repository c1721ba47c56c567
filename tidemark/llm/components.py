"""Connected components of a graph that is given by its edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (a, b); a component's smallest node names it.

    Every round points each node to the smallest of itself and its neighbours, follows the
    pointers to their ends by doubling, and keeps the links between different ends; loops
    and repeats go. An end has at least one other node pointing to it, so a round leaves
    at most half the nodes, and rounds and doublings grow with the logarithm of the nodes.
    Joins are plain equi-joins with one row a node on one side, so a node with very many
    links is split like any skewed key. Links with a null end are ignored; no links give no
    rows.
    """
    edges = stored(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        "edges",
    )
    labels = None
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = _ends(
            both.groupBy(F.col("a").alias("node")).agg(
                F.least(F.first("a"), F.min("b")).alias("parent")
            )
        )
        left = step.withColumnsRenamed({"node": "a", "parent": "a_parent"})
        right = step.withColumnsRenamed({"node": "b", "parent": "b_parent"})
        moved = edges.join(left, "a").join(right, "b")
        edges = stored(
            moved.select(
                F.least("a_parent", "b_parent").alias("a"),
                F.greatest("a_parent", "b_parent").alias("b"),
            )
            .filter("a <> b")
            .distinct(),
            "edges",
        )
        if labels is None:
            labels = step.withColumnRenamed("parent", "component")
        else:
            follow = step.withColumnsRenamed({"node": "component", "parent": "_next"})
            labels = labels.join(follow, "component", "left").select(
                "node", F.coalesce("_next", "component").alias("component")
            )
        labels = stored(labels, "labels")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def _ends(pointers: DataFrame) -> DataFrame:
    """``node, parent``, where each parent is followed to the end of its pointers."""
    step = stored(pointers, "parents")
    while True:
        above = step.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
        # An end points to itself, so every parent is a node as well.
        higher = step.join(above, "parent").select(
            "node", F.col("_above").alias("parent"), (F.col("_above") < F.col("parent")).alias("_moved")
        )
        higher = stored(higher, "parents")
        step = higher.drop("_moved")
        if not higher.filter("_moved").limit(1).count():
            return step
