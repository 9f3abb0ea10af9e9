"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a group-by and an equi-join of (node, neighbour) rows; no neighbourhood is ever
gathered into one row, so a node may have any number of neighbours. Edges between steps are
written under the shared folder, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrastry.session import materialize


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: a node's larger (or smaller) neighbours are hung on its smallest neighbour."""
    both = edges if not large else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    hung = both.join(low, "a").where((F.col("b") > F.col("a")) if large else F.lit(True)).select(F.col("b").alias("x"), F.col("low").alias("y"))
    if not large:
        hung = hung.union(low.select(F.col("a").alias("x"), F.col("low").alias("y")))
    return hung.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node.

    ``edges`` has columns a and b of one orderable type, without NULL; loops and repeated
    edges do no harm. An empty table gives an empty table."""
    state = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        state = materialize(star(star(state, True), False), "edges")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum((F.hash("a", "b")).cast("long"))).first()
        if now == mark:
            break
        mark = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
