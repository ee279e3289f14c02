"""Call trees as flat rows (root_id, path, depth, node_id); a path never visits a node twice."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.analysis import roots
from graphloom.operators.graph import SYMBOLS
from graphloom.operators.queries import first_named
from graphloom.plans.fixpoint import sized
from graphloom.plans.scratch import Scratch
from graphloom.schemas import NotFound

DEPTH, FALLBACK = 3, 5


def grow(start: DataFrame, edges: DataFrame, depth: int = DEPTH, fallback: DataFrame | None = None) -> DataFrame:
    """Tree rows from start (node_id) along distinct edges (src, dst), depth levels of edges at most.

    A node that its own path has already visited is a leaf. fallback (src, dst, rank): leaves for nodes that have no
    children while more than one level is left. Each level is one join; rows grow with the number of paths.
    """
    scratch = Scratch(start.sparkSession)
    links = sized(scratch.save(edges.select("src", "dst").distinct(), "calls"))
    node = F.col("node_id")
    level = start.select(node.alias("root_id"), F.array(node).alias("path"), F.lit(0).cast("long").alias("depth"), node, F.lit(False).alias("leaf"))
    level = scratch.save(level, "level")
    out = level
    for d in range(1, depth + 1):
        open_ = level.where("NOT leaf")
        grown = open_.join(links, node == F.col("src")).select(
            "root_id", F.concat("path", F.array("dst")).alias("path"), F.lit(d).cast("long").alias("depth"), F.col("dst").alias("node_id"), F.array_contains("path", F.col("dst")).alias("leaf")
        )
        if fallback is not None and depth - d >= 1:
            bare = open_.join(links.select(F.col("src").alias("node_id")), "node_id", "left_anti")
            extra = bare.join(fallback.where(F.col("rank") <= FALLBACK), node == F.col("src")).select(
                "root_id", F.concat("path", F.array("dst")).alias("path"), F.lit(d).cast("long").alias("depth"), F.col("dst").alias("node_id"), F.lit(True).alias("leaf")
            )
            grown = grown.union(extra)
        level = scratch.save(grown, "level")
        out = out.union(level)
    return out


def _described(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    about = nodes.select("node_id", "name", "kind", F.col("start_line").alias("line"), F.col("usr").alias("file"))
    return rows.join(about, "node_id").select("root_id", "path", "depth", "node_id", "name", "kind", "line", "file", "leaf")


def _links(edges: DataFrame, direction: str) -> DataFrame:
    calls = edges.where("kind = 'Call'")
    return calls if direction == "callees" else calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def fallback_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, rank): functions and classes that any edge leads to, numbered by id for each source."""
    symbols = nodes.where(F.col("kind").isin(SYMBOLS)).select(F.col("node_id").alias("dst"))
    found = edges.select("src", "dst").distinct().join(symbols, "dst", "left_semi")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("rank") <= FALLBACK).select("src", "dst", "rank")


def call_tree(nodes: DataFrame, edges: DataFrame, root: str, direction: str = "callees", depth: int = DEPTH, ast_fallback: bool = False) -> DataFrame:
    """The tree below (or, for callers, above) the first node with that name, else the first function. `*` gives the forest."""
    if root == "*":
        return call_forest(nodes, edges, direction, depth, ast_fallback)
    scratch = Scratch(nodes.sparkSession)
    start = scratch.save(first_named(nodes, root).select("node_id"), "root")
    if not start.limit(1).count():
        start = scratch.save(nodes.where("kind = 'Function'").orderBy("node_id").limit(1).select("node_id"), "root")
        if not start.limit(1).count():
            raise NotFound(root)
    rows = grow(start, _links(edges, direction), depth, fallback_links(nodes, edges) if ast_fallback else None)
    return _described(rows, nodes)


def call_forest(nodes: DataFrame, edges: DataFrame, direction: str = "callees", depth: int = DEPTH, ast_fallback: bool = False) -> DataFrame:
    """One tree for every root, each with its own paths."""
    rows = grow(roots(nodes, edges).select("node_id"), _links(edges, direction), depth, fallback_links(nodes, edges) if ast_fallback else None)
    return _described(rows, nodes)


def nested(rows: DataFrame) -> str:
    """A tree's rows as nested JSON. A tree is bounded by its depth; it is put together on the driver."""
    made: dict[tuple, dict] = {}
    tops = []
    for r in rows.orderBy("root_id", "depth", "path").toLocalIterator():
        item = {"name": r.name, "kind": r.kind, "line": r.line, "file": r.file, "children": []}
        made[r.root_id, tuple(r.path)] = item
        (made[r.root_id, tuple(r.path[:-1])]["children"] if r.depth else tops).append(item)
    return json.dumps(tops[0] if len(tops) == 1 else tops)


def flatten(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a tree's rows: distinct (id, name, kind, line, file) with id name@file:line, and edges between different ids."""
    label = F.concat(F.coalesce("name", F.lit("?")), F.lit("@"), F.coalesce("file", F.lit("")), F.lit(":"), F.col("line").cast("string"))
    own = rows.withColumn("id", label)
    above = own.select("root_id", F.col("path").alias("above"), F.col("id").alias("source"))
    joined = own.where("depth > 0").withColumn("above", F.slice("path", F.lit(1), F.size("path") - 1)).join(above, ["root_id", "above"])
    edges = joined.select("source", F.col("id").alias("target")).where("source <> target").distinct()
    return own.select("id", "name", "kind", "line", "file").distinct(), edges
