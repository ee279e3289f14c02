"""Loops over edge tables: reachability and nearest ancestors.

Every loop keeps its state in tables below spark.checkpoint.dir, expands several hops in one job, remembers what it has
visited and so ends on any graph. Only row counts come back to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import Scratch

HOPS = 4
_BROADCAST = 200_000


def sized(table: DataFrame, rows: int = _BROADCAST) -> DataFrame:
    """A written table, marked for broadcast if it has at most so many rows."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def reach(seeds: DataFrame, edges: DataFrame, by: list[str] | None = None, depth: int | None = None, hops: int = HOPS) -> DataFrame:
    """(*by, node, hop) for every node reachable from the seeds (*by, node), themselves at hop 0, along edges (src, dst).

    hop is the least number of edges; depth bounds it. Each job walks several hops and drops what was visited before.
    """
    by, scratch = by or [], Scratch(seeds.sparkSession)
    links = sized(scratch.save(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "links"))
    visited = scratch.save(seeds.select(*by, "node").where("node IS NOT NULL").distinct().withColumn("hop", F.lit(0).cast("long")), "seen")
    frontier, done = visited, 0
    while depth is None or done < depth:
        steps = hops if depth is None else min(hops, depth - done)
        walks, now = [], frontier.select(*by, "node")
        for step in range(1, steps + 1):
            now = now.join(links, F.col("node") == F.col("src")).select(*by, F.col("dst").alias("node")).distinct()
            walks.append(now.withColumn("hop", F.lit(done + step).cast("long")))
        found = reduce(DataFrame.union, walks).groupBy(*by, "node").agg(F.min("hop").alias("hop"))
        new = scratch.save(found.join(visited.select(*by, "node"), [*by, "node"], "left_anti"), "new")
        done += steps
        if new.isEmpty():
            break
        visited = visited.union(new)
        frontier = new.where(F.col("hop") == done)
        if done % (8 * hops) == 0:
            visited = scratch.save(visited, "seen")
        if frontier.isEmpty():
            break
    return visited


def reached(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): the seeds (node) and every node reachable from them along edges (src, dst), without hops.

    Edges that start where nothing leads are left out, and a node with one edge into it is one with its predecessor, found
    by pointer jumping; only what is left is walked. So long thin graphs cost a logarithmic number of jobs.
    """
    scratch = Scratch(seeds.sparkSession)
    start = scratch.save(seeds.select("node").where("node IS NOT NULL").distinct(), "seeds")
    links = edges.where("src <> dst").select("src", "dst").distinct().join(start.select(F.col("node").alias("dst")), "dst", "left_anti")
    links = scratch.save(links.select("src", "dst"), "links")
    size, homes = links.count(), []
    while size:
        first, last = size, None
        while last is None or size < 0.7 * last:
            entered = links.select(F.col("dst").alias("src")).union(start.select(F.col("node").alias("src"))).distinct()
            after = scratch.save(links.join(entered, "src", "left_semi").select("src", "dst"), "links")
            size, last, links = after.count(), size, after
        into = scratch.save(links.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"), F.count("*").alias("c")), "into")
        own = into.select("node", (F.col("c") > 1).alias("is_target")).union(start.select("node", F.lit(True)))
        home = scratch.save(nearest(own, into.where("c = 1").select("node", "parent")), "home")  # rings without a way in have none
        homes.append(home)
        several = links.join(into.where("c > 1").select(F.col("node").alias("dst")), "dst")
        across = several.join(home, F.col("src") == F.col("node")).select(F.col("target").alias("src"), "dst").where("src <> dst").distinct()
        links = scratch.save(across, "links")
        size = links.count()
        if size > 0.7 * first:
            break
    found = reach(start, links).select("node") if size else start
    for home in reversed(homes):
        below = home.join(found.select(F.col("node").alias("target")), "target").select("node")
        found = scratch.save(below, "reached")
    return found


def nearest(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, target) by pointer jumping: the first target on the way node, parent, parent's parent and so on.

    nodes: (node, is_target); parents: (node, parent), one parent each. Nodes on a cycle without a target get none.
    """
    scratch = Scratch(nodes.sparkSession)
    state = nodes.join(parents, "node", "left").select("node", F.when(F.col("is_target"), F.col("node")).alias("target"), F.when(~F.col("is_target"), F.col("parent")).alias("up"))
    state = scratch.save(state, "up")
    open_ = state.where("target IS NULL AND up IS NOT NULL").count()
    while open_:
        above = state.select(F.col("node").alias("up"), F.col("target").alias("above"), F.col("up").alias("next"))
        state = scratch.save(state.join(above, "up", "left").select("node", F.coalesce("target", "above").alias("target"), F.when(F.coalesce("target", "above").isNull(), F.col("next")).alias("up")), "up")
        left = state.where("target IS NULL AND up IS NOT NULL").count()
        if left == open_:
            break
        open_ = left
    return state.where("target IS NOT NULL").select("node", "target")
