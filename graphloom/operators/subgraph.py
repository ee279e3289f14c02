"""Neighbourhoods and induced subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import SYMBOLS
from graphloom.plans.fixpoint import reach, sized
from graphloom.plans.scratch import Scratch


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among chosen (node_id)."""
    ids = chosen.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst", "kind")


def focal_graph(nodes: DataFrame, edges: DataFrame, name: str, max_nodes: int = 200, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes with hop and index, Call edges) around all functions and classes of a name, calls followed both ways.

    Expansion is by whole hops; the nearest max_nodes stay, ties by id. index counts from 0 in that order.
    """
    calls = edges.where("kind = 'Call'").select("src", "dst")
    both = calls.union(calls.select("dst", "src"))
    seeds = nodes.where(F.col("kind").isin(SYMBOLS) & (F.col("name") == name)).select(F.col("node_id").alias("node"))
    near = reach(seeds, both, depth=depth).orderBy("hop", "node").limit(max_nodes).select(F.col("node").alias("node_id"), "hop")
    near = sized(Scratch(nodes.sparkSession).save(near, "focal"))
    index = F.row_number().over(Window.orderBy("hop", "node_id")) - 1  # of max_nodes rows at most
    chosen = nodes.join(near, "node_id").withColumn("index", index.cast("long"))
    return chosen, induced(edges.where("kind = 'Call'"), near)


def subgraph_by_kind(nodes: DataFrame, edges: DataFrame, kind: str, max_nodes: int = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges of all kinds) of the first max_nodes nodes of a kind by id; any other kind than Function or Class is all."""
    match = nodes.where(F.col("kind") == kind) if kind in SYMBOLS else nodes
    chosen = sized(Scratch(nodes.sparkSession).save(match.orderBy("node_id").limit(max_nodes), "kind"))
    return chosen, induced(edges, chosen)


def annotate(chosen: DataFrame, cycle: DataFrame | None = None, dead: DataFrame | None = None, by_name: bool = False) -> DataFrame:
    """chosen with is_cycle and is_dead from tables that have node_id, or name if by_name."""
    key = "name" if by_name else "node_id"
    for flag, table in (("is_cycle", cycle), ("is_dead", dead)):
        if table is not None:
            chosen = chosen.join(table.select(key).distinct().withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return chosen
