"""Connected components by repeated contraction; nothing but a count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node of `edges` (a long, b long): root is one node per component.

    A round hangs each node under its least neighbour, shortens paths to roots, and keeps the edges between roots; the edges of a star or a clique
    vanish in one round. Minima are aggregated before the shuffle, so a node with very many links is no hot group."""
    live = scratch.write(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e0")
    labels, k = None, 0
    while not live.isEmpty():
        both = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = scratch.write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("node"), "p"), f"{name}-p{k}-0")
        jump = 0
        while True:
            over = up.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            twice = up.join(over, "p").select("node", F.col("p").alias("p0"), F.col("pp").alias("p"))
            moved = twice.join(over, "p").select("node", F.col("pp").alias("p"), (F.col("pp") != F.col("p0")).alias("moved"))
            jump += 1
            moved = scratch.write(moved, f"{name}-p{k}-{jump}")
            up = moved.select("node", "p")
            if moved.filter("moved").isEmpty():
                break
        old = labels.select("node", F.col("root").alias("p0")) if labels is not None else None
        if old is None:
            labels = up.select("node", F.col("p").alias("root"))
        else:
            labels = old.join(up.select(F.col("node").alias("p0"), "p"), "p0", "left").select("node", F.coalesce("p", "p0").alias("root"))
            labels = scratch.write(labels, f"{name}-l{k}")
        a = up.select(F.col("node").alias("a"), F.col("p").alias("ra"))
        b = up.select(F.col("node").alias("b"), F.col("p").alias("rb"))
        kept = live.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        k += 1
        live = scratch.write(kept, f"{name}-e{k}")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return labels
