"""Connected components of an undirected edge list, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) to (node, component): the smallest node that can be reached.

    A round points every node at the smallest of its neighbours and itself, follows the pointers
    once more, and contracts the edges; edges shrink by at least half a round.  Edges, pointers and
    labels are distributed tables throughout, cut by a write; a node of any degree is aggregated with
    map-side combine.  Rows with nulls or loops add their nodes only.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null").distinct(), "cc-edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node"))
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        near = edges.unionAll(edges.select("b", "a")).groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        near = near.select("u", F.least("u", "m").alias("p"))
        up = near.select(F.col("u").alias("p"), F.col("p").alias("q"))
        point = materialize(near.join(up, "p").select("u", F.col("q").alias("p")), "cc-pointers")
        labels = labels.join(point, labels["component"] == point["u"], "left").select("node", F.coalesce("p", "component").alias("component"))
        labels = materialize(labels, "cc-labels")
        to_a, to_b = point.select(F.col("u").alias("a"), F.col("p").alias("pa")), point.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        edges = materialize(edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
    return labels
