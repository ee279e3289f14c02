"""The engine: a code base or a graph, and every question as a method that returns a DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from graphloom.functions.names import clean_nodes, entry_list
from graphloom.operators import analysis, diff, graph, metrics, queries, subgraph, tables, trees
from graphloom.operators.parse import parse_files
from graphloom.plans.scratch import Scratch
from graphloom.schemas import GraphError
from graphloom.sinks import text
from graphloom.sources import files as sources
from graphloom.sources.cache import FactCache, load_graph, save_graph


class Engine:
    """nodes and edges, with calls as found (raw) and lifted to functions (calls)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, errors: DataFrame | None = None):
        scratch = Scratch(nodes.sparkSession)
        self.spark = nodes.sparkSession
        self.nodes, self.edges, self.errors = scratch.save(nodes, "nodes"), scratch.save(edges, "edges"), errors

    @classmethod
    def from_files(cls, files: DataFrame, cache: str | None = None, collapse: bool = False, errors: DataFrame | None = None) -> Engine:
        """The graph of FILES, in all their languages; with a cache, only new contents are parsed. collapse: see symbol_nodes.

        errors: (path, error) of files that could not be read; they are added to those that could not be parsed.
        """
        facts, failed = parse_files(files) if cache is None else FactCache(files.sparkSession, cache).parsed(files, parse_files)
        errors = failed if errors is None else errors.union(failed)
        nodes, edges = graph.build_graph(Scratch(files.sparkSession).save(facts, "facts"), collapse)
        return cls(clean_nodes(nodes), edges, errors)

    @classmethod
    def from_path(cls, spark: SparkSession, root: str, languages: list[str] | None = None, cache: str | None = None, max_depth: int | None = None) -> Engine:
        return cls.from_files(sources.read_sources(spark, root, languages, max_depth=max_depth), cache)

    @classmethod
    def from_zip(cls, spark: SparkSession, path: str) -> Engine:
        """The graph of an archive, in all languages that its files' extensions tell."""
        from pyspark.sql import functions as F

        from graphloom.functions.languages import language_of

        archives = spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("raw"))
        entries = sources.unzip(archives)
        rows = entries.where("error IS NULL").withColumn("language", language_of(F.col("path"), strict=True)).where("language <> 'Unknown'")
        return cls.from_files(sources.as_files(rows), errors=entries.where("error IS NOT NULL").select("path", "error"))

    @classmethod
    def from_commands(cls, spark: SparkSession, commands: str, directory: str, cache: str | None = None) -> Engine:
        """The graph of the C and C++ sources below a directory that a compilation database names."""
        from pyspark.sql import functions as F

        found = sources.files_of_commands(sources.walk(spark, directory), sources.compile_commands(spark, commands, directory))
        return cls.from_files(sources.as_files(found.withColumn("language", F.lit("Cpp"))), cache)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Engine:
        return cls(*load_graph(spark, path))

    def save(self, path: str) -> None:
        save_graph(self.nodes, self.edges, path)

    @cached_property
    def calls(self) -> DataFrame:
        """Edges with calls lifted to functions."""
        return Scratch(self.spark).save(graph.as_graph(self.nodes, self.edges)[1], "lifted")

    def _entries(self, entries: str) -> list[str]:
        return entry_list(entries)

    def stats(self) -> DataFrame:
        return graph.counts(self.nodes, self.edges)

    def graph(self, focus: str | None = None, kind: str = "Function", max_nodes: int = 200, depth: int = 1, show_cycles: bool = False, show_dead: bool = False, entries: str = "main") -> tuple[DataFrame, DataFrame]:
        """A subgraph around a name or of a kind, with flags on demand."""
        chosen, edges = subgraph.focal_graph(self.nodes, self.calls, focus, max_nodes, depth) if focus else subgraph.subgraph_by_kind(self.nodes, self.calls, kind, max_nodes)
        cycle = analysis.call_cycles(self.nodes, self.calls, members=True) if show_cycles else None
        dead = analysis.dead_code(self.nodes, self.calls, self._entries(entries)) if show_dead else None
        return subgraph.annotate(chosen, cycle, dead), edges

    def node(self, name: str) -> DataFrame:
        return queries.node_detail(self.nodes, self.calls, name)

    def functions(self, search: str = "", sort: str = "name", descending: bool = False, entries: str = "main") -> DataFrame:
        return tables.function_table(metrics.function_metrics(self.nodes, self.calls, self._entries(entries)), search, sort, descending)

    def classes(self, search: str = "") -> DataFrame:
        return tables.search(metrics.class_metrics(self.nodes, self.calls), search)

    def files(self) -> DataFrame:
        return metrics.file_metrics(self.nodes, self.calls)

    def call_tree(self, root: str = "main", direction: str = "callees", depth: int = trees.DEPTH, ast_fallback: bool = False) -> DataFrame:
        if direction not in ("callees", "callers"):
            raise GraphError(f"direction {direction}")
        return trees.call_tree(self.nodes, self.calls, root, direction, depth, ast_fallback)

    def callers(self, name: str) -> DataFrame:
        return queries.callers(self.nodes, self.edges, name)

    def callees(self, name: str) -> DataFrame:
        return queries.callees(self.nodes, self.edges, name)

    def unused(self) -> DataFrame:
        return queries.unused(self.nodes, self.edges)

    def cycles(self) -> DataFrame:
        return analysis.call_cycles(self.nodes, self.calls)

    def dead_code(self, entries: str = "main") -> DataFrame:
        return analysis.dead_code(self.nodes, self.calls, self._entries(entries))

    def complexity(self, min_nodes: int = 0) -> DataFrame:
        return analysis.complexity(self.nodes, self.edges, min_nodes=min_nodes)

    def chains(self) -> DataFrame:
        return analysis.chains(self.calls)

    def report(self, entries: str = "main") -> DataFrame:
        return metrics.report(self.nodes, self.calls, self._entries(entries))

    def diff(self, new: Engine) -> tuple[DataFrame, DataFrame]:
        return diff.diff_nodes(self.nodes, new.nodes), diff.diff_edges((self.nodes, self.calls), (new.nodes, new.calls))

    def dot(self) -> DataFrame:
        return text.dot_lines(self.nodes, self.edges)

    def html_report(self, title: str = "Report", entries: str = "main") -> str:
        parts = [("Totals", self.report(entries)), ("Functions", self.functions(entries=entries)), ("Cycles", self.cycles()), ("Dead code", self.dead_code(entries).select("name", "start_line"))]
        return text.html_page(title, parts, text.graph_json(self.nodes, self.calls))

    def html_diff(self, new: Engine, title: str = "Difference") -> str:
        changes = diff.changed_names((self.nodes, self.calls), (new.nodes, new.calls))
        nodes, edges = diff.overlay((self.nodes, self.calls), (new.nodes, new.calls))
        return text.html_page(title, [("Changes", changes.orderBy("status", "name"))], text.graph_json(nodes, edges))
