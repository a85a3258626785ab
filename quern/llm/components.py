"""Connected components of an edge table, by repeated contraction.

Each round, every vertex points to its smallest neighbour (itself included), the
pointers are shortened by jumping, and the edges are redrawn between the
vertices pointed to.  A star is gone after one round and a chain shrinks by a
constant factor.  All state is in tables; the driver sees row counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize


def components(edges: DataFrame, a: str, b: str, jumps: int = 3) -> DataFrame:
    """(vertex, component) for every vertex of an edge; the component is its smallest vertex."""
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "points")
        point = first
        for _ in range(jumps):
            point = point.join(point.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p"))
        point = materialize(point, "points")
        discard(first)
        old = [] if labels is None else [labels]
        if labels is None:
            labels = point.select(F.col("u").alias("vertex"), F.col("p").alias("component"))
        else:
            step = point.select(F.col("u").alias("component"), "p")
            labels = labels.join(step, "component", "left").select("vertex", F.coalesce("p", "component").alias("component"))
        labels = materialize(labels, "labels")
        to_u = point.select("u", F.col("p").alias("pu"))
        to_v = point.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        drawn = edges.join(to_u, "u").join(to_v, "v").where("pu <> pv")
        left = materialize(drawn.select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct(), "edges")
        discard(point, edges, *old)
        edges = left
    if labels is None:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return labels
