"""Connected components of a link table by repeated contraction, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node it reaches.

    Every node moves to the least of itself and its neighbours and the links move along, until no link
    joins different nodes. Stars, the common case, take one round; a chain's length at least halves every
    other round. Each round's tables are written, so lineage stays short.
    """
    pairs = staged(links.where("a <> b").select("a", "b").distinct(), "links")
    label = first = None
    while not pairs.isEmpty():
        ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
        moves = staged(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("to")), "moves")
        before = pairs
        a, b = moves.select(F.col("node").alias("a"), F.col("to").alias("ta")), moves.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = pairs.join(a, "a").join(b, "b").where("ta <> tb")
        pairs = staged(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
        if label is None:
            label, first = moves.select("node", F.col("to").alias("component")), moves
        else:
            step = moves.select(F.col("node").alias("component"), "to")
            old = label
            label = staged(label.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
            discard(old, first, moves)
            first = None
        discard(before)
    if label is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label
