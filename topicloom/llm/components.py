"""Connected components of an undirected graph by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.session import discard, materialize


def _roots(parents: DataFrame) -> DataFrame:
    """(node, parent) with every parent its own parent: pointers double until nothing moves."""
    while True:
        further = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        stepped = parents.join(further, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved"))
        stepped = materialize(stepped, "parents")
        if stepped.where("moved").isEmpty():
            discard(stepped)
            return parents
        discard(parents)
        parents = stepped.drop("moved")
        parents._scratch = stepped._scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node each node of ``edges`` reaches.

    A round hooks every node to the least node around it, follows the hooks to their roots
    and puts the roots in the place of their nodes; edges inside a root are gone, and the
    next round has the few that are left. Rounds are written to the shared folder and deleted when
    the next no longer needs them. Nulls link nothing.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    pairs = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    layers = []
    while not layers or not pairs.isEmpty():
        around = pairs.union(pairs.select("v", "u")).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
        layer = _roots(materialize(around.select("node", F.least("node", "least").alias("parent")), "parents"))
        layers.append(layer)
        left = layer.select(F.col("node").alias("u"), F.col("parent").alias("x"))
        right = layer.select(F.col("node").alias("v"), F.col("parent").alias("y"))
        met = pairs.join(left, "u").select("x", "v").distinct().join(right, "v").where("x <> y")
        spent = pairs
        pairs = materialize(met.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "links")
        discard(spent)
    # roots of a round are nodes of the next; the last round's roots are the components
    named = layers[-1].select("node", F.col("parent").alias("component"))
    for layer in reversed(layers[:-1]):
        upper = named.withColumnRenamed("node", "parent")
        named = layer.join(upper, "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))
    out = materialize(named, "components")
    for spent in (pairs, *layers):
        discard(spent)
    return out
