"""Connected components of a distributed edge list by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.slices import keyed_join
from tickloom.session import cut


def salted_join(facts: DataFrame, dim: DataFrame, keys: list[str], salt_on: list[str], how: str = "left") -> DataFrame:
    """``keyed_join`` that never broadcasts: Spark would measure ``dim`` before it is copied for the salts."""
    return keyed_join(facts, dim.hint("merge"), keys, salt_on, how=how)


def component_labels(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex reachable from each vertex of ``edges`` (a, b: long).

    Each round hooks every vertex to its smallest neighbour, follows one more hook, and contracts the edges
    to the hooks; a round at least halves the vertices that still have edges.  Vertices with very many
    neighbours are minima over partial sums, and joins to them are salted.  No edges: an empty table.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        hook = cut(hook)
        up = hook.select(F.col("v").alias("m"), F.col("m").alias("mm"))
        hook = cut(salted_join(hook, up, ["m"], ["v"]).select("v", F.coalesce("mm", "m").alias("m")))
        if labels is None:
            labels = hook.withColumnRenamed("m", "label")
        else:
            step = hook.select(F.col("v").alias("label"), "m")
            labels = cut(salted_join(labels, step, ["label"], ["v"]).select("v", F.coalesce("m", "label").alias("label")))
        to_a, to_b = hook.select(F.col("v").alias("a"), F.col("m").alias("ma")), hook.select(F.col("v").alias("b"), F.col("m").alias("mb"))
        moved = salted_join(salted_join(edges, to_a, ["a"], ["b"]), to_b, ["b"], ["a"])
        edges = cut(moved.where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("label"))
    return labels
