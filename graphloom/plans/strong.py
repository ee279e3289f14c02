"""Strongly connected components in rounds of little depth.

What lies on no cycle is peeled off. Then labels run along and against the edges for a bounded number of steps: if they have
settled, vertices whose smallest ancestor is their smallest descendant too are a component. If they have
not, the graph is long, and it is shortened: every vertex chooses one of its successors at random, the rings of these choices
lie within components and become one vertex each, found by doubling, and vertices with a single successor are passed over.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.components import connected_components, named
from graphloom.plans.forest import doubled
from graphloom.plans.scratch import Scratch

#: Steps that labels run before the graph is shortened, and those in one job.
STEPS, _AT_ONCE = 16, 4


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose source has an incoming and whose target an outgoing edge; others lie on no cycle."""
    return edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(
        edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"
    )


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _least_label(edges: DataFrame, scratch: Scratch, steps: int) -> DataFrame | None:
    """(node, label): the smallest vertex from which a node is reachable, itself included; None if that takes more steps."""
    labels = scratch.save(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    for _ in range(0, steps, _AT_ONCE):
        now = labels
        for _ in range(_AT_ONCE):
            sent = edges.join(now, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "label")
            now = now.union(sent).groupBy("node").agg(F.min("label").alias("label"))
        after = scratch.save(now, "labels")
        settled = after.join(labels, ["node", "label"], "left_anti").isEmpty()
        scratch.drop(labels)
        labels = after
        if settled:
            return labels
    return None


def _rings(edges: DataFrame, scratch: Scratch, turn: int) -> DataFrame:
    """(node, ring) of the vertices on rings when every vertex goes on to one successor; ring is the smallest of them."""
    choice = edges.groupBy(F.col("src").alias("node")).agg(F.min_by("dst", F.xxhash64("src", "dst", F.lit(turn))).alias("up"))
    chosen = scratch.save(choice.withColumn("low", F.least("node", "up")), "chosen")
    steps = math.ceil(math.log2(max(2, chosen.count()))) + 1
    ends = doubled(chosen, scratch, least=["low"], steps=steps)
    on = ends.where("up IS NOT NULL").select(F.col("up").alias("node")).distinct()  # after so many steps all are on a ring
    return scratch.save(ends.join(on, "node").select("node", F.col("low").alias("ring")), "rings")


def _passed_over(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """(edges that lead past the vertices with one successor, (node, up, end) of these), None without such vertices.

    end is the first vertex on a vertex's way that has no or several successors, up the next one if it is not that.
    Ways that end in a ring of vertices with one successor stay.
    """
    single = edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("next"), F.count("*").alias("c")).where("c = 1")
    single = scratch.save(single.select("node", "next"), "single")
    if single.isEmpty():
        return None
    inside = single.select(F.col("node").alias("next"), F.lit(True).alias("inside"))
    chain = scratch.save(single.join(inside, "next", "left").select("node", F.when(F.col("inside"), F.col("next")).alias("up"), F.when(F.col("inside").isNull(), F.col("next")).alias("end")), "chain")
    ways = chain
    for _ in range(math.ceil(math.log2(max(2, chain.count()))) + 1):
        if ways.where("up IS NOT NULL").isEmpty():
            break
        above = ways.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("end").alias("above"))
        ways = scratch.save(ways.join(above, "up", "left").select("node", F.col("next").alias("up"), F.coalesce("end", "above").alias("end")), "ways")
    passed = scratch.save(chain.select("node", "up").join(ways.where("end IS NOT NULL").select("node", "end"), "node"), "passed")
    left = edges.join(passed.select(F.col("node").alias("src")), "src", "left_anti")
    moved = left.join(passed.select(F.col("node").alias("dst"), "end"), "dst", "left").select("src", F.coalesce("end", "dst").alias("dst"))
    return scratch.save(moved.where("src <> dst").distinct(), "core"), passed


def _rejoined(edges: DataFrame, passed: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the vertices that were passed over and lie on a cycle, with the end of their way as component.

    Such a vertex is reached along the ways from an edge whose source is in the component of their common end.
    """
    label = scratch.save(connected_components(links, "node", "component"), "label")
    into = edges.join(passed.select(F.col("node").alias("dst"), "end"), "dst").join(passed.select(F.col("node").alias("src")), "src", "left_anti")
    for end in ("src", "end"):
        into = named(into, end, label, f"of_{end}")
    entered = into.where("of_src = of_end").select(F.col("dst").alias("node")).distinct().withColumn("marks", F.lit(1).cast("long"))
    start = passed.select("node", "up").join(entered, "node", "left").select("node", "up", F.coalesce("marks", F.lit(0)).alias("marks"))
    reached = doubled(scratch.save(start, "start"), scratch, sums=["marks"]).where("marks > 0").select("node")
    return scratch.save(passed.join(reached, "node").select("node", F.col("end").alias("component")), "rejoined")


def strong_components(edges: DataFrame, steps: int = STEPS) -> DataFrame:
    """(node, component) of the vertices on cycles of edges (src, dst); component is the smallest vertex.

    A vertex alone is on a cycle only if it has a self-loop. Null ends are ignored. steps: how far labels run before the
    graph is shortened, which changes the cost only.
    """
    scratch = Scratch(edges.sparkSession)
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    core = scratch.save(edges.where("src <> dst").select("src", "dst").distinct(), "core")
    size, turn = core.count(), 0
    found = [edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()]
    layers: list[tuple[DataFrame | None, DataFrame]] = []  # (edges before, passed) or (None, rings), in order
    while size:
        core = scratch.save(_trimmed(_trimmed(core)), "core")
        size, last = core.count(), size
        if not size or size < 0.7 * last:
            continue
        down = _least_label(core, scratch, steps)
        up = _least_label(_turned(core), scratch, steps) if down is not None else None
        if up is not None:
            same = scratch.save(down.join(up, ["node", "label"]).select("node", F.col("label").alias("component")), "component")
            found.append(same)
            a, b = (down.select(F.col("node").alias(end), F.col("label").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
            left = core.join(a, "src").join(b, "dst").where("a = b").select("src", "dst")
            left = left.join(same.select(F.col("node").alias("src")), "src", "left_anti").join(same.select(F.col("node").alias("dst")), "dst", "left_anti")
            core = scratch.save(left, "core")
        else:
            turn += 1
            rings = _rings(core, scratch, turn)
            layers.append((None, rings))
            ends = core
            for end in ("src", "dst"):
                ends = ends.join(rings.select(F.col("node").alias(end), "ring"), end, "left").withColumn(end, F.coalesce("ring", end)).drop("ring")
            core = scratch.save(ends.where("src <> dst").select("src", "dst").distinct(), "core")
            short = _passed_over(core, scratch)
            if short is not None:
                layers.append((core, short[1]))
                core = short[0]
        size = core.count()
    links = reduce(DataFrame.unionByName, found)
    if not layers:
        return links.groupBy("node").agg(F.min("component").alias("component"))
    for before, layer in reversed(layers):
        more = layer.select("node", F.col("ring").alias("component")) if before is None else _rejoined(before, layer, links, scratch)
        links = links.unionByName(more)
    return connected_components(links, "node", "component")
