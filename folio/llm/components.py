"""Connected components of an edge table by repeated contraction, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of ``edges(a, b)``; ``root`` is one node of its component.

    Each round hooks every label to its smallest neighbour, shortens the hooked chains to their
    roots and keeps the edges between different roots, so the edges shrink by at least half a
    round in practice and the number of rounds is logarithmic.  Files are as many as the edges
    left ask for, and a round's tables are deleted when the next one has replaced them.
    """
    edges = saved(edges.where("a <> b").select("a", "b").distinct(), "cc-edges")
    labels: DataFrame | None = None
    all_ends = 0
    while n := edges.count():
        ends = 2 * n
        all_ends = all_ends or ends
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("root"))
        hook = saved(hook, "cc-hook", ends)
        moved = True
        while moved:  # pointer jumping: chains halve each time
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = saved(hook.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "cc-jump", ends)
            discard(hook)
            hook, moved = jumped, not jumped.where("moved").isEmpty()
        roots = hook.select("node", "root")
        if labels is None:
            labels = saved(roots, "cc-labels", all_ends)
        else:
            step = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            old = labels
            labels = saved(old.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "cc-labels", all_ends)
            discard(old)
        a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = saved(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "cc-edges", n)
        discard(edges)
        discard(hook)
        edges = left
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
