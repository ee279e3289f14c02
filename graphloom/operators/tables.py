"""Filters and orders of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search(rows: DataFrame, text: str = "") -> DataFrame:
    """Rows whose name contains the text, whatever the case."""
    return rows.where(F.contains(F.lower("name"), F.lit(text.lower()))) if text else rows


def function_table(rows: DataFrame, text: str = "", sort: str = "name", descending: bool = False, limit: int | None = None) -> DataFrame:
    """Searched and sorted by a column, then by name and line."""
    column = F.desc(sort) if descending else F.asc(sort)
    ordered = search(rows, text).orderBy(column, *[c for c in ("name", "line") if c != sort and c in rows.columns])
    return ordered if limit is None else ordered.limit(limit)


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst), whatever its kind; AstChild goes before Call."""
    return edges.groupBy("src", "dst").agg(F.min("kind").alias("kind"))
