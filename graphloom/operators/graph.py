"""From facts to a graph: nodes by symbol, nesting edges, call edges by name, union, counts, the lifted call graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import fact_key
from graphloom.plans.fixpoint import nearest

SYMBOLS = ["Function", "Class"]
#: Kinds of the edges of calls through names: from a call site to its name, and from a name to what it defines.
NAMED, DEFINES = "Named", "Defines"


def _key(collapse: bool) -> Column:
    """usr or name; unless all facts collapse, facts that define nothing have a key of their own."""
    shared = fact_key(F.col("usr"), F.col("name"))
    return shared if collapse else F.when(F.col("kind").isin(SYMBOLS), shared).otherwise(F.concat("path", F.lit("#"), F.col("fact_id").cast("string")))


def symbol_nodes(facts: DataFrame, collapse: bool = True) -> DataFrame:
    """(key, node_id, kind, name, usr, start_line, end_line): facts with one key are one node, the first by (path, fact_id) wins.

    node_id is a 64-bit hash of the key; usr is always set. Facts without a name or usr share the key ''. With collapse
    off, only functions and classes share nodes, so a call site never hides the definition that it names.
    """
    first = F.min_by(F.struct("kind", "name", "start_line", "end_line"), F.struct("path", "fact_id")).alias("n")
    grouped = facts.withColumn("key", _key(collapse)).groupBy("key").agg(first)
    return grouped.select("key", F.xxhash64("key").alias("node_id"), "n.kind", "n.name", F.col("key").alias("usr"), "n.start_line", "n.end_line")


def _keyed(facts: DataFrame, collapse: bool) -> DataFrame:
    return facts.withColumn("node_id", F.xxhash64(_key(collapse)))


def ingest(facts: DataFrame, collapse: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, AstChild edges) of a fact table of any number of files; an edge for every fact with a parent."""
    keyed = _keyed(facts, collapse).select("path", "fact_id", "parent_id", "node_id")
    parents = keyed.select("path", F.col("fact_id").alias("parent_id"), F.col("node_id").alias("src"))
    edges = keyed.where("parent_id IS NOT NULL").join(parents, ["path", "parent_id"]).select("src", F.col("node_id").alias("dst"), F.lit("AstChild").alias("kind"))
    return symbol_nodes(facts, collapse).drop("key"), edges


def resolve_calls(facts: DataFrame, weighted: bool = False, collapse: bool = True) -> DataFrame:
    """Call edges (src, dst, kind) from every call site to every function or class of that name.

    k call sites and m definitions of a name make k * m edges. weighted counts both sides first and gives one row
    (src, dst, kind, weight) for each pair of nodes, so a frequent name costs no more than its distinct nodes.
    """
    keyed = _keyed(facts, collapse).where("name IS NOT NULL").select("name", "kind", "node_id")
    sites, defs = keyed.where("kind = 'CallSite'"), keyed.where(F.col("kind").isin(SYMBOLS))
    if not weighted:
        both = sites.select("name", F.col("node_id").alias("src")).join(defs.select("name", F.col("node_id").alias("dst")), "name")
        return both.select("src", "dst", F.lit("Call").alias("kind"))
    sites = sites.groupBy("name", F.col("node_id").alias("src")).agg(F.count("*").alias("k"))
    defs = defs.groupBy("name", F.col("node_id").alias("dst")).agg(F.count("*").alias("m"))
    pairs = sites.join(defs, "name").groupBy("src", "dst").agg(F.sum(F.col("k") * F.col("m")).alias("weight"))
    return pairs.select("src", "dst", F.lit("Call").alias("kind"), "weight")


def named_calls(facts: DataFrame, collapse: bool = True) -> DataFrame:
    """(src, dst, kind, name): calls through names, k + m rows for k call sites and m definitions of a name.

    A Named edge goes from a call site to the vertex of its name, a Defines edge from there to each function or class.
    Name vertices are 64-bit hashes that no node has; names that are only called or only defined are left out. Whoever
    walks along both kinds gets from sites to definitions as along Call edges. Null names make no edge.
    """
    keyed = _keyed(facts, collapse).where("name IS NOT NULL").select("name", "kind", "node_id")
    sites = keyed.where("kind = 'CallSite'").select("name", "node_id").distinct()
    defs = keyed.where(F.col("kind").isin(SYMBOLS)).select("name", "node_id").distinct()
    hub, names = F.xxhash64(F.lit("name"), "name"), lambda t: t.select("name").distinct()
    into = sites.join(names(defs), "name", "left_semi").select(F.col("node_id").alias("src"), hub.alias("dst"), F.lit(NAMED).alias("kind"), "name")
    out = defs.join(names(sites), "name", "left_semi").select(hub.alias("src"), F.col("node_id").alias("dst"), F.lit(DEFINES).alias("kind"), "name")
    return into.unionByName(out)


def expanded(edges: DataFrame) -> DataFrame:
    """edges with calls through names as distinct Call edges, k * m for each name."""
    into, out = edges.where(F.col("kind") == NAMED), edges.where(F.col("kind") == DEFINES)
    calls = into.select("src", F.col("dst").alias("hub")).join(out.select(F.col("src").alias("hub"), "dst"), "hub").select("src", "dst").distinct()
    return edges.where(~F.col("kind").isin(NAMED, DEFINES)).select("src", "dst", "kind").unionByName(calls.withColumn("kind", F.lit("Call")))


def call_steps(edges: DataFrame) -> DataFrame:
    """Edges that a walk along calls takes: Call edges and both halves of calls through names."""
    return edges.where(F.col("kind").isin("Call", NAMED, DEFINES))


def build_graph(facts: DataFrame, collapse: bool = True, by_name: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with nesting and call edges. Building a union of facts is the same as merging their graphs.

    by_name: calls go through names (named_calls), so edges grow with the facts whatever names are frequent. as_graph,
    callers, unused, dead_code and call_cycles take such edges; expanded() makes Call edges of them for all else.
    """
    nodes, nested = ingest(facts, collapse)
    return nodes, nested.unionByName(named_calls(facts, collapse).drop("name") if by_name else resolve_calls(facts, collapse=collapse))


def merge(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union of two graphs; nodes with one usr (or name) become one, the first graph's attributes win, edges are kept."""
    both = first[0].withColumn("rank", F.lit(0)).unionByName(second[0].withColumn("rank", F.lit(1)))
    keyed = both.withColumn("key", fact_key(F.col("usr"), F.col("name")))
    attributes = F.min_by(F.struct("kind", "name", "start_line", "end_line"), F.struct("rank", "node_id")).alias("n")
    nodes = keyed.groupBy("key").agg(attributes).select(F.xxhash64("key").alias("node_id"), "n.kind", "n.name", F.col("key").alias("usr"), "n.start_line", "n.end_line")
    moved = []
    for (own, edges) in (first, second):
        place = own.select("node_id", F.xxhash64(fact_key(F.col("usr"), F.col("name"))).alias("new"))
        ends = edges.join(place.select(F.col("node_id").alias("src"), F.col("new").alias("s")), "src").join(place.select(F.col("node_id").alias("dst"), F.col("new").alias("d")), "dst")
        moved.append(ends.select(F.col("s").alias("src"), F.col("d").alias("dst"), "kind"))
    return nodes, moved[0].unionByName(moved[1])


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count."""
    return nodes.agg(F.count("*").alias("node_count")).join(edges.agg(F.count("*").alias("edge_count")))


def filter_facts(facts: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Facts of some kinds; a fact whose parent is left out hangs on its nearest ancestor that stays."""
    kinds = kinds or ["Function", "Class", "CallSite"]
    ids = facts.select(F.struct("path", "fact_id").alias("node"), F.col("kind").isin(kinds).alias("is_target"))
    parents = facts.where("parent_id IS NOT NULL").select(F.struct("path", "fact_id").alias("node"), F.struct("path", F.col("parent_id").alias("fact_id")).alias("parent"))
    kept = nearest(ids, parents).select("node.path", F.col("node.fact_id").alias("parent_id"), F.col("target.fact_id").alias("new_parent"))
    chosen = facts.where(F.col("kind").isin(kinds)).join(kept, ["path", "parent_id"], "left")
    return chosen.withColumn("parent_id", F.col("new_parent")).select(facts.columns)


def ast_parents(edges: DataFrame) -> DataFrame:
    """(node, parent): one AstChild parent for each node, the one with the largest id. Self-loops are no parents."""
    nested = edges.where("kind = 'AstChild' AND src <> dst")
    return nested.groupBy(F.col("dst").alias("node")).agg(F.max("src").alias("parent"))


def enclosing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, function_id): the nearest function above a node, or the node itself if it is one; others are left out."""
    marked = nodes.select(F.col("node_id").alias("node"), (F.col("kind") == "Function").alias("is_target"))
    return nearest(marked, ast_parents(edges)).select(F.col("node").alias("node_id"), F.col("target").alias("function_id"))


def lift(nodes: DataFrame, edges: DataFrame, distinct: bool = True) -> DataFrame:
    """(src, dst): calls from the function that encloses the source to the definition. Sources outside functions are dropped."""
    lifted = _lifted(nodes, edges, "Call").select("src", "dst")
    return lifted.distinct() if distinct else lifted


def _lifted(nodes: DataFrame, edges: DataFrame, *kinds: str) -> DataFrame:
    """(src, dst, kind) of edges of these kinds from the functions that enclose their sources."""
    calls = edges.where(F.col("kind").isin(*kinds)).select("src", "dst", "kind")
    return calls.join(enclosing(nodes, edges), F.col("src") == F.col("node_id")).select(F.col("function_id").alias("src"), "dst", "kind")


def as_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with its Call and Named edges lifted to functions, each once; nesting and Defines edges stay."""
    lifted = _lifted(nodes, edges, "Call", NAMED).distinct()
    return nodes, edges.where(~F.col("kind").isin("Call", NAMED)).select("src", "dst", "kind").unionByName(lifted)
