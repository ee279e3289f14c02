"""Small graphs made by hand."""

from graphloom.schemas import EDGES, NODES


def graph(spark, nodes, edges):
    """nodes: (id, kind, name, start, end[, usr]); edges: (src, dst[, kind])."""
    rows = [(n[0], n[1], n[2], n[5] if len(n) > 5 else None, n[3], n[4]) for n in nodes]
    return spark.createDataFrame(rows, NODES), spark.createDataFrame([(e[0], e[1], e[2] if len(e) > 2 else "Call") for e in edges], EDGES)


def analysis_graph(spark):
    """a, b, c call in a ring, d calls itself, e is alone, f has a chain of ten variables."""
    nodes = [(i, "Function", name, i + 1, i + 1) for i, name in enumerate("abcdef")] + [(10 + i, "Variable", None, 6, 6) for i in range(10)]
    chain = [(5, 10, "AstChild")] + [(10 + i, 11 + i, "AstChild") for i in range(9)]
    return graph(spark, nodes, [(0, 1), (1, 2), (2, 0), (3, 3), *chain])


def query_graph(spark):
    """foo and bar call each other through call sites, baz is alone."""
    nodes = [(0, "Function", "foo", 1, 3), (1, "Function", "bar", 10, 12), (2, "Function", "baz", 20, 22), (3, "CallSite", "bar", 2, 2), (4, "CallSite", "foo", 11, 11)]
    return graph(spark, nodes, [(0, 3, "AstChild"), (1, 4, "AstChild"), (3, 1), (4, 0)])


def metrics_graph(spark):
    nodes = [
        (0, "Function", "main", 1, 5, "main.cpp"),
        (1, "Function", "helper", 10, 12, "helper.cpp"),
        (2, "Class", "MyClass", 20, 30, "myclass.cpp"),
        (3, "Function", "method", 22, 25, "myclass.cpp"),
    ]
    return graph(spark, nodes, [(0, 1), (2, 3, "AstChild")])
