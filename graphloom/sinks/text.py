"""DOT and JSON as tables of lines, HTML reports as driver-side pages of bounded tables."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import SYMBOLS
from graphloom.operators.tables import dedup_edges

HEADER = ["digraph CallGraph {", "  rankdir=LR;", "  node [shape=box, style=rounded];"]
#: Rows that a page shows; a page is for reading, the tables themselves go to Parquet or JSON.
PAGE_ROWS = 2000


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, other, line): the lines of a DOT file, to be ordered by the other columns. Quotes in names are escaped."""
    spark = nodes.sparkSession
    number = "part int, id bigint, other bigint, line string"
    frame = spark.createDataFrame([(0, i, 0, line) for i, line in enumerate(HEADER)] + [(3, 0, 0, "}")], number)
    name = F.replace(F.replace(F.coalesce("name", F.lit("?")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    box = F.concat(F.lit("  n"), F.col("node_id").cast("string"), F.lit(' [label="'), name, F.lit("\\nline "), F.col("start_line").cast("string"), F.lit('"];'))
    boxes = nodes.where(F.col("kind").isin(SYMBOLS)).select(F.lit(1), F.col("node_id"), F.lit(0).cast("long"), box)
    arrow = F.concat(F.lit("  n"), F.col("src").cast("string"), F.lit(" -> n"), F.col("dst").cast("string"), F.lit(";"))
    return frame.union(boxes).union(edges.where("kind = 'Call'").select(F.lit(2), "src", "dst", arrow))


def write_dot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    dot_lines(nodes, edges).orderBy("part", "id", "other").select("line").write.text(path)


def json_lines(table: DataFrame) -> DataFrame:
    """(value): every row as a JSON object."""
    return table.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def graph_json(nodes: DataFrame, edges: DataFrame, limit: int = PAGE_ROWS) -> str:
    """{nodes, edges} of a bounded subgraph, edges once for each pair."""
    chosen = nodes.orderBy("node_id").limit(limit)
    ids = chosen.select("node_id")
    inside = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    rows = lambda t: [json.loads(r.value) for r in json_lines(t).toLocalIterator()]
    return json.dumps({"nodes": rows(chosen), "edges": rows(dedup_edges(inside))})


_PAGE = """<!doctype html>
<html><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:2px 8px;text-align:left}}</style>
</head><body><h1>{title}</h1>
{body}
<script type="application/json" id="graph">{graph}</script>
</body></html>
"""


def table_html(table: DataFrame, limit: int = PAGE_ROWS) -> str:
    rows = table.limit(limit).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in table.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def html_page(title: str, sections: list[tuple[str, DataFrame]], graph: str = "{}") -> str:
    """A self-contained page of tables with the graph's JSON inside."""
    body = "\n".join(f"<h2>{html.escape(name)}</h2>{table_html(table)}" for name, table in sections)
    return _PAGE.format(title=html.escape(title), body=body, graph=graph.replace("</", "<\\/"))
