"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import Scratch


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is the smallest node reachable.

    Each round hangs the larger neighbours of a node on its smallest neighbour (large star), then all smaller
    ones (small star); the number of rounds is logarithmic in practice. Hubs are aggregated map-side and the
    joins can be split by AQE, so one node may hold most edges. Self-loops name a node without linking it.
    Null ends are ignored. Rounds are written as tables, so a lost executor costs one round at most.
    """
    scratch = Scratch(edges.sparkSession)
    ends = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(
        F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")
    )
    pairs = scratch.save(ends.distinct(), "edges")
    now = pairs.where("u <> v")
    seen, last = _fingerprint(now), None
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        after = scratch.save(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct(), "round")
        print_after = _fingerprint(after)
        if last is not None:
            scratch.drop(last)
        now, last = after, after
        if print_after == seen:
            break
        seen = print_after
    else:
        raise RuntimeError("connected components did not converge")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def merged(label: DataFrame | None, links: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) of the nodes of a former label (node, component) and of new links between nodes.

    Only the links between former components are contracted; the former table is relabelled, not contracted again.
    """
    scratch = Scratch(links.sparkSession)
    if label is None:
        return scratch.save(connected_components(links, src, dst), "label")
    ends = links.select(F.col(src).alias("s"), F.col(dst).alias("d"))
    for end in ("s", "d"):
        ends = named(ends, end, label, end)
    moved = scratch.save(connected_components(ends, "s", "d"), "moved")
    root = moved.select(F.col("node").alias("component"), F.col("component").alias("root"))
    old = label.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    new = moved.join(label.select("node"), "node", "left_anti").select("node", "component")
    return scratch.save(old.union(new), "label")


def named(rows: DataFrame, node: str, label: DataFrame | None, component: str) -> DataFrame:
    """rows with the component of their column `node` in the column `component`; nodes without a label are their own."""
    if label is None:
        return rows.withColumn(component, F.col(node))
    joined = rows.join(label.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col(node) == F.col("_n"), "left")
    return joined.withColumn(component, F.coalesce("_c", node)).drop("_n", "_c")
