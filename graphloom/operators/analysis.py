"""Whole-graph analyses: cycles, size, dead code, roots, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import DEFINES, NAMED, SYMBOLS, call_steps
from graphloom.plans.components import connected_components
from graphloom.plans.fixpoint import reach, reached
from graphloom.plans.forest import sizes_below
from graphloom.plans.scratch import Scratch
from graphloom.plans.strong import strong_components

NODE_CAP = 100_000


def _among_symbols(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Call edges between functions and classes, or from them to names and from names to them."""
    ids = nodes.where(F.col("kind").isin(SYMBOLS)).select("node_id")
    calls = lambda kind: edges.where(F.col("kind") == kind).select("src", "dst")
    known = lambda table, end: table.join(ids.withColumnRenamed("node_id", end), end, "left_semi").select("src", "dst")
    return known(known(calls("Call"), "src"), "dst").union(known(calls(NAMED), "src")).union(known(calls(DEFINES), "dst"))


def call_cycles(nodes: DataFrame, edges: DataFrame, members: bool = False) -> DataFrame:
    """(component, functions, length): every group of functions and classes that call each other, and self-callers.

    functions is the sorted list of names, ? for a missing one. members: (node_id, component) instead. component is the
    smallest node of the group. Names that calls go through are no members; edges are lifted.
    """
    label = strong_components(_among_symbols(nodes, edges))
    label = label.join(nodes.select(F.col("node_id").alias("node")), "node", "left_semi")
    label = label.join(label.groupBy("component").agg(F.min("node").alias("least")), "component").select("node", F.col("least").alias("component"))
    if members:
        return label.withColumnRenamed("node", "node_id")
    named = label.join(nodes.select(F.col("node_id").alias("node"), F.coalesce("name", F.lit("?")).alias("name")), "node")
    return named.groupBy("component").agg(F.array_sort(F.collect_list("name")).alias("functions"), F.count("*").alias("length"))


def complexity(nodes: DataFrame, edges: DataFrame, cap: int = NODE_CAP, min_nodes: int = 0) -> DataFrame:
    """(node_id, function_name, ast_node_count, start_line, truncated) of every function: distinct nodes below it and itself.

    Sizes of a forest are sums; only functions above nodes with several parents walk to what they share. Counts stop at cap. Functions of fewer than min_nodes nodes are left out.
    """
    functions = nodes.where("kind = 'Function'")
    nested = edges.where("kind = 'AstChild'").select("src", "dst")
    ids = lambda table: table.select(F.col("node_id").alias("node"))
    sizes = sizes_below(ids(nodes), nested, ids(functions), lambda seeds, links: reach(seeds, links, by=["root"])).withColumnRenamed("node", "node_id")
    rows = functions.join(sizes, "node_id").select(
        "node_id", F.col("name").alias("function_name"), F.least("n", F.lit(cap).cast("long")).alias("ast_node_count"), "start_line", (F.col("n") >= cap).alias("truncated")
    )
    return rows.where(F.col("ast_node_count") >= min_nodes)


def entry_nodes(nodes: DataFrame, entries: list[str]) -> DataFrame:
    """(node): for each entry name the function or class with the smallest id."""
    match = nodes.where(F.col("kind").isin(SYMBOLS) & F.col("name").isin(entries))
    return match.groupBy("name").agg(F.min("node_id").alias("node")).select("node")


def dead_code(nodes: DataFrame, edges: DataFrame, entries: list[str] | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """Functions that no entry reaches along Call edges; all functions if no entry matches. seeds (node) may replace entries."""
    start = entry_nodes(nodes, entries or ["main"]) if seeds is None else seeds
    seen = reached(start, call_steps(edges)).select(F.col("node").alias("node_id"))
    return nodes.where("kind = 'Function'").join(seen, "node_id", "left_anti")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and classes that nothing calls; all of them if there is none."""
    symbols = nodes.where(F.col("kind").isin(SYMBOLS))
    called = edges.where("kind = 'Call'").select(F.col("dst").alias("node_id")).distinct()
    free = Scratch(nodes.sparkSession).save(symbols.join(called, "node_id", "left_anti"), "roots")
    return free if free.limit(1).count() else symbols


def chains(edges: DataFrame) -> DataFrame:
    """(node, component): weakly connected parts of the call graph, named by their smallest node."""
    return connected_components(edges.where("kind = 'Call'").select("src", "dst"))
