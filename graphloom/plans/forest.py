"""Nested edges as a forest: sums and marks below nodes in a logarithmic number of steps.

A node with one parent hangs on it. Edges into nodes with several parents, and one edge of every ring of single parents, are
cut: they are kept apart, and their targets are roots. Every step doubles the distance that is looked over, so
the number of jobs grows with the logarithm of the depth and no pair of a node and an ancestor is ever listed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import Scratch


def doubled(state: DataFrame, scratch: Scratch, sums: list[str] = (), marks: list[str] = (), least: list[str] = (), steps: int | None = None) -> DataFrame:
    """A table (node, up, ...) after `up` has moved to the root and beyond, or by 2 ** steps edges; up is null beyond a root.

    sums become those of the node and all nodes below it, marks (booleans) hold if they do for the node or one
    above it, least are the smallest of the node's value and those of the nodes that up passes. Without `steps` it ends when
    every up is null, or when it has passed as many edges as there are nodes, which only rings do.
    """
    bound = steps if steps is not None else max(1, math.ceil(math.log2(max(2, state.count())))) + 1
    for _ in range(bound):
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"), *[F.col(c).alias(f"above_{c}") for c in (*marks, *least)])
        moved = state.join(above, "up", "left")
        for c in marks:
            moved = moved.withColumn(c, F.col(c) | F.coalesce(f"above_{c}", F.lit(False)))
        for c in least:
            moved = moved.withColumn(c, F.least(c, f"above_{c}"))
        if sums:
            below = state.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(*[F.sum(c).alias(f"below_{c}") for c in sums])
            moved = moved.join(below, "node", "left").withColumns({c: F.col(c) + F.coalesce(f"below_{c}", F.lit(0)) for c in sums})
        after = scratch.save(moved.select("node", F.col("next").alias("up"), *sums, *marks, *least), "doubled")
        scratch.drop(state)
        state = after
        if steps is None and state.where("up IS NOT NULL").isEmpty():
            break
    return state


@dataclass
class Forest:
    """parents: (node, up) for every node, up null for roots; cut: the edges (src, dst) that are not in the forest."""

    parents: DataFrame
    cut: DataFrame

    def start(self, scratch: Scratch, **columns) -> DataFrame:
        return scratch.save(self.parents.withColumns(columns), "start")


def forest_of(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> Forest:
    """The forest over nodes (node) and the ends of edges (src, dst); self-loops and repeated edges count for nothing."""
    edges = scratch.save(edges.where("src <> dst").select("src", "dst").distinct(), "nested")
    parents = edges.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("up"), F.count("*").alias("c"))
    every = nodes.select("node").union(edges.select(F.explode(F.array("src", "dst")))).distinct()
    single = parents.where("c = 1").select("node", "up")
    rows = scratch.save(every.join(single, "node", "left"), "parents")
    several = parents.where("c > 1").select(F.col("node").alias("dst"))
    reached = doubled(scratch.save(rows.withColumn("low", F.col("up")), "low"), scratch, least=["low"])
    rings = reached.where("up IS NOT NULL AND node = low").select("node")
    if rings.isEmpty():
        return Forest(rows, scratch.save(edges.join(several, "dst").select("src", "dst"), "cut"))
    rings = scratch.save(rings.withColumn("ring", F.lit(True)), "rings")
    cut = edges.join(several.union(rings.select("node")), "dst").select("src", "dst")
    open_ = rows.join(rings, "node", "left").select("node", F.when(F.col("ring").isNull(), F.col("up")).alias("up"))
    return Forest(scratch.save(open_, "parents"), scratch.save(cut, "cut"))


def sizes_below(nodes: DataFrame, edges: DataFrame, roots: DataFrame, walk) -> DataFrame:
    """(node, n) for every root (node): the distinct nodes below it along edges (src, dst), itself counted.

    In a forest n is one sum. Roots with a cut edge below them walk on, by `walk(seeds, edges)`, which gives (root, node), over what
    is left when all subtrees without cut edges are folded into their parents.
    """
    scratch = Scratch(edges.sparkSession)
    forest = forest_of(nodes, edges, scratch)
    one = F.lit(1).cast("long")
    if forest.cut.isEmpty():
        total = doubled(forest.start(scratch, n=one), scratch, sums=["n"])
        return roots.join(total, "node").select("node", "n")
    ways = forest.cut.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("ways"))
    start = scratch.save(forest.parents.join(ways, "node", "left").select("node", "up", one.alias("n"), F.coalesce("ways", F.lit(0)).alias("ways")), "start")
    total = doubled(start, scratch, sums=["n", "ways"]).select("node", "n", "ways")
    simple = roots.join(total.where("ways = 0"), "node").select("node", "n")
    winding = scratch.save(forest.parents.join(total.where("ways > 0"), "node"), "winding")  # nodes above a cut edge
    targets = forest.cut.select(F.col("dst").alias("node")).distinct().join(total, "node").select("node", "n")
    inner = winding.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("n").alias("inner"))
    weight = winding.select("node", "n").union(targets).distinct().join(inner, "node", "left").select("node", (F.col("n") - F.coalesce("inner", F.lit(0))).alias("w"))
    spine = winding.where("up IS NOT NULL").select(F.col("up").alias("src"), F.col("node").alias("dst")).union(forest.cut)
    seeds = roots.join(winding.select("node"), "node", "left_semi").select(F.col("node").alias("root"), "node")
    found = walk(seeds, spine).join(weight, "node").groupBy(F.col("root").alias("node")).agg(F.sum("w").alias("n"))
    return simple.union(found.select("node", "n"))


def below(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): the roots (node) and all nodes below them along edges (src, dst)."""
    scratch = Scratch(edges.sparkSession)
    forest = forest_of(nodes, edges, scratch)
    marked = scratch.save(roots.select("node").where("node IS NOT NULL").distinct().withColumn("mark", F.lit(True)), "roots")
    while True:
        start = forest.parents.join(marked, "node", "left").select("node", "up", F.coalesce("mark", F.lit(False)).alias("mark"))
        state = doubled(scratch.save(start, "start"), scratch, marks=["mark"])
        hit = state.where("mark").select("node")
        entered = forest.cut.join(hit.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        new = scratch.save(entered.join(hit, "node", "left_anti").withColumn("mark", F.lit(True)), "entered")
        if new.isEmpty():
            return hit.union(marked.select("node")).distinct()
        marked = marked.union(new)
