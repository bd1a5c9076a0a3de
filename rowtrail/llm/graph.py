"""Connected components of an edge table, by hooking and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtrail.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a, b): (node, root) of every node that is not the smallest of its component.

    Each round every node hooks on its smallest neighbour below itself, chains are shortened by joining the parents with
    themselves, and edges are rewritten between roots. A node of any degree costs one row per edge; nothing is gathered.
    NULL ends are left out. An edge table without rows gives no rows.
    """
    clean = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    todo = scratch.write(clean, "edges")
    roots: DataFrame | None = None
    while not todo.isEmpty():
        parent = scratch.write(todo.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "parents")
        while True:
            above = parent.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped = parent.join(above, "root", "left").select(
                "node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")
            )
            jumped = scratch.write(jumped, "jumped")
            moved = not jumped.filter("moved").isEmpty()
            scratch.drop(parent)
            parent = jumped
            if not moved:
                break
        parent = parent.select("node", "root")
        if roots is None:
            merged = parent
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            merged = roots.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")).unionByName(parent)
        roots = scratch.write(merged, "roots")
        ends = [parent.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab"]
        lifted = todo.join(ends[0], "a", "left").join(ends[1], "b", "left").select(
            F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")
        )
        last = todo
        todo = scratch.write(
            lifted.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
        )
        scratch.drop(last)
    return roots if roots is not None else todo.select(F.col("a").alias("node"), F.col("b").alias("root"))
