"""Connected components of an edge table by contraction.

Every round each node points to the neighbour (or itself) that comes first in a random order of the round, pointers are
followed once more, and edges are renamed by them. The graph shrinks by a constant share a round in expectation, also on
long chains. Hubs are combined on the map side; nothing but a row count reaches the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long); nodes are joined if and only if a path joins them."""
    clean = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    live = keep(edges.where("a <> b").select(*clean).distinct(), "edges")
    roots: DataFrame | None = None
    turn = 0
    while live.limit(1).count():
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(order("b")).alias("n")).select(
            F.col("a").alias("node"), F.least("n", order("a"))["v"].alias("to"))
        first = keep(first, "pointers")
        again = first.select(F.col("node").alias("to"), F.col("to").alias("root"))
        pointer = keep(first.join(again, "to").select("node", "root"), "pointers")
        named = lambda c: pointer.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        live = keep(
            live.join(named("a"), "a").join(named("b"), "b").where("a_root <> b_root")
            .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
        if roots is None:
            roots = pointer
        else:
            moved = pointer.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = keep(roots.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        turn += 1
    if roots is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
