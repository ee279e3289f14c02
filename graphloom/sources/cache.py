"""Stored graphs, and facts by content so that only changed files are parsed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from graphloom.schemas import EDGES, FACTS, NODES, conform

PARSER_VERSION = "2"
_STORED = FACTS.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", sha256 string, version string, error string"


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    for name, table, schema in (("nodes", nodes, NODES), ("edges", edges, EDGES)):
        conform(table, schema).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges); edges to nodes that do not exist are dropped."""
    nodes, edges = spark.read.schema(NODES).parquet(f"{path}/nodes"), spark.read.schema(EDGES).parquet(f"{path}/edges")
    ids = nodes.select("node_id")
    return nodes, edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst", "kind")


class FactCache:
    """Facts stored by (path, language, parser version, content hash)."""

    def __init__(self, spark: SparkSession, path: str, version: str = PARSER_VERSION):
        self.spark, self.path, self.version = spark, path, version

    def stored(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(_STORED).parquet(self.path)
        except AnalysisException:
            rows = self.spark.createDataFrame([], _STORED)
        return rows.where(F.col("version") == self.version)

    def misses(self, files: DataFrame) -> DataFrame:
        """Files whose content has not been parsed yet."""
        return files.join(self.stored().select("path", "language", "sha256").distinct(), ["path", "language", "sha256"], "left_anti")

    def parsed(self, files: DataFrame, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
        """(facts, errors) of files (FILES), parsing only what is new; a file without facts is stored as one row with its error, if any.

        parse gives facts and errors (path, error).
        """
        new = self.misses(files)
        facts, errors = parse(new)
        found = facts.join(new.select("path", "language", "sha256"), ["path", "language"], "right").join(errors.select("path", "error"), "path", "left")
        found.withColumn("version", F.lit(self.version)).select([c.split(" ")[0] for c in _STORED.split(", ")]).write.mode("append").parquet(self.path)
        hit = self.stored().join(files.select("path", "language", "sha256"), ["path", "language", "sha256"], "left_semi")
        return conform(hit.where("fact_id IS NOT NULL"), FACTS), hit.where("error IS NOT NULL").select("path", "error").distinct()

    def facts(self, files: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The facts of parsed(), for a parse that gives facts only."""
        return self.parsed(files, lambda new: (parse(new), self.spark.createDataFrame([], "path string, error string")))[0]
