import random

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.catalog import ORACLES, QUERIES
from graphloom.functions.names import clean_nodes, entry_list, plausible_identifier, readable_name
from graphloom.operators import analysis, diff, graph, metrics, queries, subgraph, tables, trees
from graphloom.plans.components import connected_components
from graphloom.plans.fixpoint import nearest, reach, reached
from graphloom.plans.forest import below, sizes_below
from graphloom.plans.scratch import Scratch
from graphloom.plans.strong import strong_components
from graphloom.schemas import FACTS, GraphError, NotFound, check_kinds
from graphloom.sources.derived import derived_facts
from graphloom.sources.warehouse import warehouse_graph
from tests import graphs


def names(rows, column="name"):
    return sorted(r[column] for r in rows.collect())


def fact_table(spark, *facts):
    """(path, fact_id, kind, name[, parent[, usr]])"""
    rows = [(f[0], f[1], "Unknown", f[2], f[3], f[5] if len(f) > 5 else None, f[1] + 1, 0, f[1] + 1, 1, f[4] if len(f) > 4 else None, None) for f in facts]
    return spark.createDataFrame(rows, FACTS)


def test_cycles_dead_code_and_complexity(spark):
    nodes, edges = graphs.analysis_graph(spark)
    assert sorted((r.functions, r.length) for r in analysis.call_cycles(nodes, edges).collect()) == [(["a", "b", "c"], 3), (["d"], 1)]
    assert names(analysis.dead_code(nodes, edges, ["a"])) == ["d", "e", "f"]
    assert names(analysis.dead_code(nodes, edges, ["absent"])) == list("abcdef")
    size = {r.function_name: (r.ast_node_count, r.truncated) for r in analysis.complexity(nodes, edges).collect()}
    assert size["f"] == (11, False) and size["a"] == (1, False)
    assert analysis.complexity(nodes, edges, cap=5).where("truncated").count() == 1
    assert names(analysis.complexity(nodes, edges, min_nodes=2), "function_name") == ["f"]


def test_callers_callees_unused(spark):
    nodes, edges = graphs.query_graph(spark)
    assert names(queries.callers(nodes, edges, "bar"), "caller") == ["foo"]
    assert names(queries.callers(nodes, edges, "foo"), "caller") == ["bar"]
    assert names(queries.callees(nodes, edges, "foo"), "callee") == ["bar"]
    assert names(queries.callees(nodes, edges, "bar"), "callee") == ["foo"]
    assert names(queries.unused(nodes, edges)) == ["baz"]
    assert analysis.call_cycles(nodes, edges).count() == 0
    lifted = graph.as_graph(nodes, edges)[1]
    assert [r.functions for r in analysis.call_cycles(nodes, lifted).collect()] == [["bar", "foo"]]
    assert names(analysis.dead_code(nodes, lifted, ["foo"])) == ["baz"]


def test_metrics(spark):
    nodes, edges = graphs.metrics_graph(spark)
    rows = {r.name: r for r in metrics.function_metrics(nodes, edges).collect()}
    assert len(rows) == 4 and (rows["main"].loc, rows["main"].callees, rows["helper"].loc, rows["helper"].callers) == (5, 1, 3, 1)
    (cls,) = metrics.class_metrics(nodes, edges).collect()
    assert (cls.methods, cls.loc) == (1, 11)
    files = {r.path: r for r in metrics.file_metrics(nodes, edges).collect()}
    assert len(files) == 3 and (files["main.cpp"].functions, files["main.cpp"].calls) == (1, 1)
    total = metrics.report(nodes, edges).first()
    assert (total.total_functions, total.total_classes, total.total_calls, total.cycle_count, total.dead_count) == (3, 1, 1, 0, 1)
    by_name = {r.name: r.is_dead for r in metrics.function_metrics(nodes, edges, by_name=True).collect()}
    assert by_name == {"main": False, "helper": False, "MyClass": False, "method": True}


def test_ingest_merges_symbols(spark):
    assert graph.symbol_nodes(fact_table(spark, ("a", 0, "Function", "foo"), ("a", 1, "Function", "foo"))).count() == 1
    assert graph.symbol_nodes(fact_table(spark, ("a", 0, "Function", "foo"), ("a", 1, "Function", "bar"))).count() == 2
    first = graph.ingest(fact_table(spark, ("a", 0, "Function", "foo")))
    second = graph.ingest(fact_table(spark, ("b", 0, "Function", "bar"), ("b", 1, "Function", "foo")))
    assert graph.merge(first, second)[0].count() == graph.merge(second, first)[0].count() == 2
    nodes, edges = graph.build_graph(fact_table(spark, ("a", 0, "Function", "foo"), ("a", 1, "CallSite", "foo", 0)))
    calls = edges.where("kind = 'Call'").collect()
    assert nodes.count() == 1 and [(r.src == r.dst) for r in calls] == [True]
    assert graph.symbol_nodes(fact_table(spark, ("a", 0, "Variable", None), ("b", 0, "Variable", None))).first().usr == ""


def test_resolution_keeps_multiplicity(spark):
    facts = fact_table(spark, ("a", 0, "Function", "f"), ("b", 0, "Class", "f"), ("a", 1, "CallSite", "f"), ("a", 2, "CallSite", "f"), ("a", 3, "CallSite", "g"))
    assert graph.resolve_calls(facts).count() == 4
    assert [r.weight for r in graph.resolve_calls(facts, weighted=True).collect()] == [4]


def test_filter_facts_rehangs(spark):
    facts = fact_table(spark, ("a", 0, "Class", "C"), ("a", 1, "Variable", "v", 0), ("a", 2, "Function", "f", 1))
    assert {r.name: r.parent_id for r in graph.filter_facts(facts).collect()} == {"C": None, "f": 0}


def test_random_graphs_agree_with_search(spark):
    rng = random.Random(7)
    for n, m in ((30, 42),):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        table = spark.createDataFrame(edges, "src long, dst long")
        to = {v: {b for a, b in edges if a == v} for v in range(n)}

        def below(v):
            seen, todo = set(), list(to[v])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += to[x]
            return seen

        down = {v: below(v) for v in range(n)}
        expected = {v: min(x for x in down[v] | {v} if x == v or v in down[x]) for v in range(n) if v in down[v]}
        for steps in (16, 0):  # without steps the graph is shortened until nothing is left
            assert {r.node: r.component for r in strong_components(table, steps).collect()} == expected
        seeds = spark.createDataFrame([(0,), (1,)], "node long")
        found = reach(seeds, table)
        assert {r.node for r in found.collect()} == {0, 1} | down[0] | down[1]
        assert {r.node for r in reach(seeds, table, depth=1).collect()} == {0, 1} | to[0] | to[1]
        roots = seeds.withColumn("root", F.col("node"))
        assert {(r.root, r.node) for r in reach(roots, table, by=["root"]).collect()} == {(v, x) for v in (0, 1) for x in down[v] | {v}}
        label = {v: v for v in range(n)}
        for _ in range(n):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        assert {r.node: r.component for r in connected_components(table).collect()} == {v: label[v] for e in edges for v in e}


def many_graphs(rng):
    """Edges of graphs side by side: random ones of all densities, rings with tails in and out, paths both ways, ladders."""
    edges, at = [], 0
    for n, m in ((3, 3), (5, 6), (8, 9), (12, 14), (12, 30), (20, 26), (30, 35)):
        edges += [(at + rng.randrange(n), at + rng.randrange(n)) for _ in range(m)]
        at += n
    for n in (2, 20):
        edges += [(at + i, at + (i + 1) % n) for i in range(n)]
        edges += [(at, at + n)] + [(at + n + i, at + n + i + 1) for i in range(n)] + [(at + 2 * n + 1 + i, at + 2 * n + 2 + i) for i in range(n)] + [(at + 3 * n + 1, at + 1)]
        at += 3 * n + 2
    edges += [(at + i, at + i + 1) for i in range(20)] + [(at + i + 1, at + i) for i in range(20)]
    at += 40
    edges += [(at + i, at + i + d) for i in range(18) for d in (1, 2)] + [(at + 19, at + 3)]
    at += 50
    edges += [(at, at), (at + 1, at + 2), (None, at), (at, None)]
    return edges


def reachable(edges):
    to = {}
    for a, b in edges:
        if a is not None and b is not None:
            to.setdefault(a, set()).add(b)
            to.setdefault(b, set())
    down = {}
    for v in to:
        seen, todo = set(), list(to[v])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += to[x]
        down[v] = seen
    return down


@pytest.mark.parametrize("steps", [16, 0])
def test_strong_components_of_many_graphs(spark, steps):
    edges = many_graphs(random.Random(steps))
    down = reachable(edges)
    expected = {v: min([v, *(x for x in down[v] if v in down[x])]) for v in down if v in down[v]}
    found = strong_components(spark.createDataFrame(edges, "src long, dst long"), steps).collect()
    assert len(found) == len(expected) and {r.node: r.component for r in found} == expected


def test_sizes_and_nodes_below(spark):
    rng = random.Random(4)
    trees = [(v, rng.randrange(max(0, v - 9), v)) for v in range(1, 60)]  # (node, parent)
    chain = [(i + 1001, i + 1000) for i in range(60)]
    plain = [(p, v) for v, p in trees + chain]
    shared = [(rng.randrange(60), rng.randrange(1, 60)) for _ in range(6)] + [(1030, 1010), (1055, 50), (55, 1040)]
    rings = [(2000, 2001), (2001, 2002), (2002, 2000), (2001, 2003), (2003, 2004), (3000, 3001), (3001, 3000), (2500, 2500)]
    for edges in (plain, plain + shared + rings + plain[:5]):
        table = spark.createDataFrame(edges, "src long, dst long")
        down = reachable(edges)
        nodes = spark.createDataFrame([(v,) for v in [*down, 5000]], "node long")
        down[5000] = set()
        roots = [v for v in down if v % 7 == 0 or v >= 1990]
        walk = lambda seeds, links: reach(seeds, links, by=["root"])
        got = sizes_below(nodes, table, spark.createDataFrame([(v,) for v in roots], "node long"), walk).collect()
        assert len(got) == len(roots) and {r.node: r.n for r in got} == {v: len(down[v] | {v}) for v in roots}
        for chosen in ([40, 2003, 1050],):
            want = set().union(*(down.get(v, set()) | {v} for v in chosen))
            assert {r.node for r in below(nodes, table, spark.createDataFrame([(v,) for v in chosen], "node long")).collect()} == want


def test_long_path_ends(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(130)] + [(130, 0)], "src long, dst long")
    assert reach(spark.createDataFrame([(0,)], "node long"), path, hops=16).count() == 131
    assert strong_components(path).select("component").distinct().count() == 1
    nodes = spark.createDataFrame([(i, i == 0) for i in range(131)], "node long, is_target boolean")
    parents = spark.createDataFrame([(i + 1, i) for i in range(130)], "node long, parent long")
    assert nearest(nodes, parents).where("target = 0").count() == 131
    ring = spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long")
    assert nearest(spark.createDataFrame([(1, False), (2, False)], "node long, is_target boolean"), ring).count() == 0


def test_focal_and_kind_subgraphs(spark):
    nodes, edges = graphs.analysis_graph(spark)
    chosen, inside = subgraph.focal_graph(nodes, edges, "a", depth=1)
    assert names(chosen) == ["a", "b", "c"] and inside.count() == 3
    chosen, inside = subgraph.focal_graph(nodes, edges, "a", max_nodes=2, depth=3)
    assert sorted((r.name, r["index"]) for r in chosen.collect()) == [("a", 0), ("b", 1)] and inside.count() == 1
    assert subgraph.focal_graph(nodes, edges, "absent")[0].count() == 0
    chosen, inside = subgraph.subgraph_by_kind(nodes, edges, "any", 100)
    assert chosen.count() == 16 and inside.count() == edges.count()
    marked = subgraph.annotate(nodes, analysis.call_cycles(nodes, edges, members=True), analysis.dead_code(nodes, edges, ["a"]))
    assert names(marked.where("is_cycle")) == ["a", "b", "c", "d"] and names(marked.where("is_dead")) == ["d", "e", "f"]


def test_trees(spark):
    nodes, edges = graphs.analysis_graph(spark)
    rows = trees.call_tree(nodes, edges, "a", depth=5)
    assert sorted((r.depth, r.name, r.leaf) for r in rows.collect()) == [(0, "a", False), (1, "b", False), (2, "c", False), (3, "a", True)]
    assert trees.nested(rows).count('"children"') == 4
    flat, links = trees.flatten(rows)
    assert flat.count() == 3 and links.count() == 3
    assert sorted(r.name for r in trees.call_tree(nodes, edges, "a", "callers", 1).collect()) == ["a", "c"]
    assert names(trees.call_forest(nodes, edges).where("depth = 0")) == ["e", "f"]
    assert trees.call_tree(nodes, edges, "absent", depth=1).where("depth = 0").first().name == "a"
    with pytest.raises(NotFound):
        trees.call_tree(nodes.where("false"), edges, "a")
    nodes, edges = graphs.metrics_graph(spark)
    assert sorted((r.depth, r.name) for r in trees.call_tree(nodes, edges, "MyClass", ast_fallback=True).collect()) == [(0, "MyClass"), (1, "method")]


def test_diamond_has_a_row_for_each_path(spark):
    nodes, edges = graphs.graph(spark, [(i, "Function", f"f{i}", 1, 1) for i in range(4)], [(0, 1), (0, 2), (1, 3), (2, 3), (0, 1)])
    assert trees.call_tree(nodes, edges, "f0").where("name = 'f3'").count() == 2


def test_node_detail(spark):
    nodes, edges = graphs.analysis_graph(spark)
    row = queries.node_detail(nodes, edges, "b", ["d"]).first()
    assert (row.callers, row.callees, row.is_cycle, row.is_dead) == (["a"], ["c"], True, True)
    with pytest.raises(NotFound):
        queries.node_detail(nodes, edges, "absent")
    with pytest.raises(GraphError):
        queries.node_detail(nodes, edges, "")


def test_differences(spark):
    old = graphs.graph(spark, [(0, "Function", "a", 1, 1), (1, "Function", "b", 2, 2), (2, "Variable", None, 3, 3)], [(0, 1)])
    new = graphs.graph(spark, [(0, "Function", "a", 1, 1), (1, "Function", "c", 2, 2)], [(0, 1), (0, 0)])
    assert {r.name: r.status for r in diff.diff_nodes(old[0], new[0]).collect()} == {"a": "Unchanged", "b": "Removed", "c": "Added", "": "Removed"}
    assert sorted((r.source, r.target, r.status) for r in diff.diff_edges(old, new).collect()) == [("a", "a", "Added"), ("a", "b", "Removed"), ("a", "c", "Added")]
    assert diff.diff_edges(old, old).count() == 0 and diff.diff_nodes(old[0], old[0]).where("status <> 'Unchanged'").count() == 0
    assert {r.name: r.status for r in diff.changed_names(old, new).collect()} == {"a": "modified", "b": "removed", "c": "added"}
    nodes, edges = diff.overlay(old, new)
    assert sorted((r.name, r.status) for r in nodes.collect()) == [("a", "modified"), ("b", "removed"), ("c", "added")] and edges.count() == 2


def test_names(spark):
    cases = {"c:@F@main": "main", "c:@S@MyClass@F@method": "method", "c:@S@MyClass@F@MyClass#&1$@S@MyClass#": "MyClass", "helper": "helper", "": "", "@": "", "a#b": "a#b"}
    table = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.n for r in table.select("s", readable_name(F.col("s")).alias("n")).collect()} == cases
    assert entry_list(" a, b ,c") == ["a", "b", "c"]
    good = spark.createDataFrame([("x",), ("foo_1",), ("classFoo",), ("9a",), ("dir_" + "0" * 30,)], "s string")
    assert [r[0] for r in good.select(plausible_identifier(F.col("s"))).collect()] == [True, True, False, False, False]
    nodes, _ = graphs.graph(spark, [(0, "Function", "c:@F@main", 1, 1, "c:@F@main"), (1, "Variable", "v", 1, 1, "c:@v")], [])
    assert sorted((r.name, r.usr) for r in clean_nodes(nodes).collect()) == [("main", "main"), ("v", "c:@v")]


def test_tables_and_kinds(spark):
    nodes, edges = graphs.metrics_graph(spark)
    rows = metrics.function_metrics(nodes, edges)
    assert [r.name for r in tables.function_table(rows, "M", "loc", descending=True).collect()] == ["MyClass", "main", "method"]
    assert [r.kind for r in tables.dedup_edges(edges.union(edges.withColumn("kind", F.lit("AstChild")))).collect()] == ["AstChild", "AstChild"]
    assert check_kinds(nodes).count() == 4
    with pytest.raises(Exception, match="unknown kind"):
        check_kinds(nodes.withColumn("kind", F.lit("Nonsense"))).collect()


def test_empty_graph(spark):
    nodes, edges = graphs.graph(spark, [(0, "Function", "a", 1, 1)], [(0, 0)])
    nodes, edges = nodes.where("false"), edges.where("false")
    assert metrics.function_metrics(nodes, edges).count() == analysis.chains(edges).count() == analysis.call_cycles(nodes, edges).count() == 0
    assert metrics.report(nodes, edges).first().total_functions == 0


def test_calls_through_names_answer_as_call_edges_do(spark):
    rng = random.Random(51)
    for collapse in (False, True):
        rows = []
        for i in range(60):
            rows.append((f"p{i % 7}", 10 * i, rng.choice(["Function", "Function", "Class"]), f"f{rng.randrange(40)}"))
            rows += [(f"p{i % 7}", 10 * i + k, "CallSite", f"f{rng.randrange(55)}", 10 * i) for k in range(1, 1 + rng.randrange(3))]
        facts = Scratch(spark).save(fact_table(spark, *rows, ("q", 0, "CallSite", None), ("q", 1, "Function", None), ("q", 2, "CallSite", "f1")), "facts")
        nodes, plain = graph.build_graph(facts, collapse)
        named = graph.build_graph(facts, collapse, by_name=True)[1]
        plain, named = (Scratch(spark).save(t, "edges") for t in (plain, named))
        kinds = ("AstChild", "Call")
        pairs = lambda t: {tuple(r) for r in t.select("src", "dst", "kind").collect()}
        assert pairs(graph.expanded(named)) == {r for r in pairs(plain) if r[2] in kinds} and graph.expanded(plain).count() == plain.count()
        both = [Scratch(spark).save(graph.as_graph(nodes, t)[1], "lifted") for t in (plain, named)]
        assert pairs(graph.expanded(both[1])) == pairs(both[0])
        same = lambda f, tables: len({frozenset(map(tuple, f(t).collect())) for t in tables}) == 1  # noqa: E731,B023
        assert same(lambda t: analysis.call_cycles(nodes, t, members=True).select("node_id", "component"), both)  # noqa: B023
        assert same(lambda t: analysis.dead_code(nodes, t, ["f1", "f2"]).select("node_id"), both)  # noqa: B023
        assert same(lambda t: queries.unused(nodes, t).select("node_id"), (plain, named)) and same(lambda t: queries.callers(nodes, t, distinct=True), (plain, named))  # noqa: B023
        assert same(lambda t: queries.callers(nodes, t, "f3", distinct=True), (plain, named))  # noqa: B023


def test_a_frequent_name_costs_sites_and_definitions(spark):
    """10^5 call sites and 10^4 definitions of one name are 1.1 * 10^5 edges, not 10^9; dead code and cycles walk through them."""
    text = "CAST(NULL AS STRING)"
    defs = f"SELECT concat('p', id) AS path, 0L AS fact_id, 'Function' AS kind, 'go' AS name, concat('u', id) AS usr, CAST(NULL AS BIGINT) AS parent_id FROM range(10000)"
    sites = f"SELECT concat('p', id % 10000), id + 1, 'CallSite', 'go', {text}, 0L FROM range(100000)"
    facts = spark.sql(f"{defs} UNION ALL {sites} UNION ALL SELECT 'x', 0L, 'Function', 'main', {text}, NULL UNION ALL SELECT 'x', 1L, 'CallSite', 'go', {text}, 0L UNION ALL SELECT 'x', 2L, 'Function', 'alone', {text}, NULL")
    facts = Scratch(spark).save(facts.selectExpr("*", "1L AS start_line", "1L AS end_line"), "facts")
    nodes, edges = (Scratch(spark).save(t, "hub") for t in graph.build_graph(facts, collapse=False, by_name=True))
    assert edges.where("kind <> 'AstChild'").count() == 100_001 + 10_000
    lifted = Scratch(spark).save(graph.as_graph(nodes, edges)[1], "lifted")
    assert lifted.where("kind <> 'AstChild'").count() == 10_001 + 10_000
    assert [r.name for r in analysis.dead_code(nodes, lifted, ["main"]).collect()] == ["alone"]
    members = analysis.call_cycles(nodes, lifted, members=True)
    assert [tuple(r) for r in members.groupBy("component").count().select("count").collect()] == [(10_000,)]


def test_dead_code_of_long_chains_takes_few_jobs(spark, monkeypatch):
    """Chains of rising ids, with a fork and its join, a ring on the way and one without a way in."""
    n, calls = 600, [(i, i + 1) for i in range(299)] + [(i, i + 1) for i in range(300, 599)] + [(10, 12), (40, 30), (599, 300), (100, 0), (None, 300), (5, None)]
    nodes, edges = graphs.graph(spark, [(i, "Function", f"f{i}", 1, 1) for i in range(n)], calls)
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, codec=None: saved.append(name) or save(self, df, name, codec))
    dead = analysis.dead_code(nodes, edges, seeds=spark.createDataFrame([(3,), (None,)], "node long"))
    assert {r.node_id for r in dead.collect()} == set(range(300, n))
    assert len(saved) < 60


def test_reached_nodes_like_a_search(spark):
    rng = random.Random(11)
    for _ in range(4):
        edges = [(rng.randrange(50), rng.randrange(50)) for _ in range(rng.randint(20, 90))]
        starts, seen = [rng.randrange(52) for _ in range(3)], set()
        todo = list(starts)
        while todo:
            if (node := todo.pop()) not in seen:
                seen.add(node)
                todo += [b for a, b in edges if a == node]
        found = reached(spark.createDataFrame([(x,) for x in starts], "node long"), spark.createDataFrame(edges, "src long, dst long"))
        assert sorted(r.node for r in found.collect()) == sorted(seen)


def test_keys_whose_product_is_beyond_64_bits(spark, tmp_path):
    """Call sites of far keys have distinct numbers in the order of the SQL's, and cycles are those of the SQL; two sites of one order differ."""
    rows = [(10**15 + i // 2, i % 5, 10**5 - i % 3, 1 + i % 2, 50.0, "R") for i in range(12)] + [(2**61, 4, 1, 1, 1.0, "R"), (10**15 + 40, 7, 7, 1, 50.0, "A")]
    rows += [rows[3]]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"n{i % 3}", f"Brand#{i % 2}", i) for i in range(5)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert sorted(map(tuple, QUERIES["a_cycles"](spark, str(tmp_path)).collect())) == sorted(con.execute(ORACLES["a_cycles"]).fetchall()) != []
    nodes, edges = (t.collect() for t in warehouse_graph(spark, str(tmp_path)))
    exact = sorted((((o * 5 + p) * (10**5 + 1) + s) * 8 + n, p) for o, p, s, n, q, flag in set(rows) if q > 46 and flag == "R")
    sites = sorted(r.node_id for r in nodes if r.kind == "CallSite")
    assert len(set(sites)) == 12 and [e.src for e in sorted((e for e in edges if e.dst in sites), key=lambda e: e.dst)] == [p for _, p in exact]
    assert {e.src for e in edges if e.kind == "Call"} == set(sites) and derived_facts(spark, str(tmp_path)).where("kind = 'CallSite'").select("fact_id").distinct().count() == 12
