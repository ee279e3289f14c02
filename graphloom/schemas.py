"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

# The kinds of nodes and edges.
KINDS = ["Function", "Class", "Variable", "Parameter", "CallSite", "Namespace", "Enum"]
EDGE_KINDS = ["AstChild", "Call", "Reference"]


def _table(text: str) -> StructType:
    kinds = {"string": StringType(), "bigint": LongType(), "strings": ArrayType(StringType())}
    return StructType([StructField(n, kinds[k]) for n, k in (part.split() for part in text.split(", "))])


FILES = _table("path string, language string, content string, sha256 string")
FACTS = _table(
    "path string, fact_id bigint, language string, kind string, name string, usr string, start_line bigint, start_col bigint, "
    "end_line bigint, end_col bigint, parent_id bigint, source_file string"
)
NODES = _table("node_id bigint, kind string, name string, usr string, start_line bigint, end_line bigint")
EDGES = _table("src bigint, dst bigint, kind string")
COMPILE_COMMANDS = _table("file string, command string, arguments strings")


class GraphError(Exception):
    """A request that the graph cannot answer."""


class UnsupportedLanguage(GraphError):
    """A language that no parser is registered for."""


class NotFound(GraphError):
    """A node that does not exist."""


def conform(table: DataFrame, schema: StructType) -> DataFrame:
    """The columns of a schema, cast and in order; missing ones are null."""
    have = set(table.columns)
    return table.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def check_kinds(nodes: DataFrame) -> DataFrame:
    """nodes, failing at run time on a kind that the model does not have."""
    bad = F.col("kind").isNull() | ~F.col("kind").isin(KINDS)
    return nodes.withColumn("kind", F.when(bad, F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("null"))))).otherwise(F.col("kind")))
