"""Questions about single symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.analysis import dead_code, call_cycles
from graphloom.operators.graph import DEFINES, NAMED, SYMBOLS, enclosing
from graphloom.plans.fixpoint import sized
from graphloom.plans.forest import below
from graphloom.plans.scratch import Scratch
from graphloom.schemas import GraphError, NotFound


def by_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("kind") == kind)


def calls_to(nodes: DataFrame, name: str) -> DataFrame:
    """Call sites with that name."""
    return nodes.where((F.col("kind") == "CallSite") & (F.col("name") == name))


def callers(nodes: DataFrame, edges: DataFrame, name: str | None = None, distinct: bool = False) -> DataFrame:
    """(caller_id, caller, callee_id, callee): a row for each Call edge into a function or class of that name.

    The caller is the function that encloses the edge's source; edges from outside functions are dropped. Without a
    name, all definitions are targets. Calls through names have a row for each calling function, name and definition.
    """
    targets = nodes.where(F.col("kind").isin(SYMBOLS) & (F.lit(True) if name is None else F.col("name") == name))
    into = edges.where(F.col("kind").isin("Call", DEFINES)).join(targets.select(F.col("node_id").alias("dst"), F.col("name").alias("callee")), "dst")
    within = enclosing(nodes, edges)
    owned = into.where("kind = 'Call'").select("src", "dst", "callee").join(within, F.col("src") == F.col("node_id")).drop("node_id", "src")
    hubs = edges.where(F.col("kind") == NAMED).join(within, F.col("src") == F.col("node_id")).select("function_id", F.col("dst").alias("hub")).distinct()
    through = into.where(F.col("kind") == DEFINES).select(F.col("src").alias("hub"), "dst", "callee").join(hubs, "hub").drop("hub")
    owned = owned.unionByName(through)
    named = owned.join(nodes.select(F.col("node_id").alias("function_id"), F.col("name").alias("caller")), "function_id")
    rows = named.select(F.col("function_id").alias("caller_id"), "caller", F.col("dst").alias("callee_id"), "callee")
    return rows.distinct() if distinct else rows


def first_named(nodes: DataFrame, name: str, kinds: list[str] | None = None) -> DataFrame:
    """The node with that name and the smallest id, as a table of one row or none."""
    match = nodes.where((F.col("name") == name) & (F.col("kind").isin(kinds) if kinds else F.lit(True)))
    return match.orderBy("node_id").limit(1)


def subtree_calls(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): the distinct call sites below the roots (node) along AstChild edges."""
    found = below(nodes.select(F.col("node_id").alias("node")), edges.where("kind = 'AstChild'"), roots)
    return found.join(nodes.where("kind = 'CallSite'").select(F.col("node_id").alias("node")), "node", "left_semi").select("node").distinct()


def callees(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(callee_id, callee, site_id, line): what the first function of that name calls, for every call site below it."""
    root = Scratch(nodes.sparkSession).save(first_named(nodes, name, ["Function"]).select(F.col("node_id").alias("node")), "root")
    sites = subtree_calls(nodes, edges, root).withColumnRenamed("node", "src")
    targets = nodes.where(F.col("kind").isin(SYMBOLS)).select(F.col("node_id").alias("dst"), F.col("name").alias("callee"))
    lines = nodes.select(F.col("node_id").alias("src"), F.col("start_line").alias("line"))
    found = edges.where("kind = 'Call'").join(sites, "src").join(targets, "dst").join(lines, "src")
    return found.select(F.col("dst").alias("callee_id"), "callee", F.col("src").alias("site_id"), "line")


def unused(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions that no Call edge reaches; a self-loop counts as a call."""
    called = edges.where(F.col("kind").isin("Call", DEFINES)).select(F.col("dst").alias("node_id")).distinct()
    return nodes.where("kind = 'Function'").join(called, "node_id", "left_anti")


def node_detail(nodes: DataFrame, edges: DataFrame, name: str, entries: list[str] | None = None) -> DataFrame:
    """One row for the first node of that name: name, kind, line, file, callers, callees (sorted names), is_cycle, is_dead.

    edges are lifted. Raises GraphError for an empty name and NotFound if there is no such node.
    """
    if not name:
        raise GraphError("a name is needed")
    node = sized(Scratch(nodes.sparkSession).save(first_named(nodes, name), "node"))
    if not node.limit(1).count():
        raise NotFound(name)
    calls = edges.where("kind = 'Call'")
    named = nodes.select(F.col("node_id").alias("other"), F.col("name").alias("other_name"))
    sorted_names = lambda side, other: (
        calls.join(node.select(F.col("node_id").alias(side)), side).join(named, F.col(other) == F.col("other")).agg(F.array_sort(F.collect_set("other_name")).alias("names"))
    )
    into, out = sorted_names("dst", "src").withColumnRenamed("names", "callers"), sorted_names("src", "dst").withColumnRenamed("names", "callees")
    cycle = call_cycles(nodes, edges, members=True).select(F.col("node_id"), F.lit(True).alias("is_cycle"))
    dead = dead_code(nodes, edges, entries or ["main"]).select("node_id", F.lit(True).alias("is_dead"))
    marked = node.join(cycle, "node_id", "left").join(dead, "node_id", "left").join(into).join(out)
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return marked.select("name", "kind", F.col("start_line").alias("line"), F.col("usr").alias("file"), "callers", "callees", flag("is_cycle"), flag("is_dead"))
