"""Differences between two versions of a graph, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first(nodes: DataFrame) -> DataFrame:
    """The first node of every name; missing names are ''."""
    named = nodes.withColumn("name", F.coalesce("name", F.lit("")))
    return named.groupBy("name").agg(F.min_by(F.struct("kind", F.col("start_line").alias("line"), F.col("usr").alias("file"), "node_id"), "node_id").alias("n"))


def diff_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, kind, line, file, status) of every name of either side; attributes of the old side unless Added."""
    a, b = _first(old).withColumnRenamed("n", "a"), _first(new).withColumnRenamed("n", "b")
    both = a.join(b, "name", "full_outer")
    status = F.when(F.col("a").isNull(), "Added").when(F.col("b").isNull(), "Removed").otherwise("Unchanged")
    n = F.coalesce("a", "b")
    return both.select("name", n["kind"].alias("kind"), n["line"].alias("line"), n["file"].alias("file"), status.alias("status"))


def named_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (source, target, kind) by name."""
    name = lambda end, out: nodes.select(F.col("node_id").alias(end), F.coalesce("name", F.lit("")).alias(out))
    return edges.join(name("src", "source"), "src").join(name("dst", "target"), "dst").select("source", "target", "kind").distinct()


def diff_edges(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], unchanged: bool = False) -> DataFrame:
    """(source, target, kind, status) of the edges that only one side has, or of all edges."""
    a, b = named_edges(*old).withColumn("a", F.lit(True)), named_edges(*new).withColumn("b", F.lit(True))
    both = a.join(b, ["source", "target", "kind"], "full_outer")
    status = F.when(F.col("a").isNull(), "Added").when(F.col("b").isNull(), "Removed").otherwise("Unchanged")
    rows = both.select("source", "target", "kind", status.alias("status"))
    return rows if unchanged else rows.where("status <> 'Unchanged'")


def _degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, degree): outgoing Call edges of the first node of each name."""
    out = edges.where("kind = 'Call'").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n"))
    first = _first(nodes).select("name", "n.node_id").where("name <> ''")
    return first.join(out, "node_id", "left").select("name", F.coalesce("n", F.lit(0).cast("long")).alias("degree"))


def changed_names(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(name, status): added, removed, and modified where the number of outgoing calls differs."""
    a, b = _degrees(*old).withColumnRenamed("degree", "a"), _degrees(*new).withColumnRenamed("degree", "b")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return a.join(b, "name", "full_outer").select("name", status.alias("status")).where("status IS NOT NULL")


# Colours of a difference.
COLOURS = {"added": "#4caf50", "removed": "#f44336", "modified": "#ff9800", "same": "#9e9e9e"}


def overlay(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes with status and colour, the new edges): all new nodes and the named nodes that only the old side has."""
    changes = changed_names(old, new)
    gone = changes.where("status = 'removed'").select("name")
    nodes = new[0].unionByName(old[0].join(gone, "name", "left_semi").select(new[0].columns))
    marked = nodes.join(changes, "name", "left").withColumn("status", F.coalesce("status", F.lit("same")))
    colour = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    return marked.withColumn("colour", F.try_element_at(colour, F.col("status"))), new[1]
