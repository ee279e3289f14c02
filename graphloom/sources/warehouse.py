"""A code graph derived from the star schema: brands are classes, parts functions, some line items call sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Common table expressions, valid in Spark and DuckDB, over part and lineitem.
PRELUDE = """
n AS (SELECT (SELECT count(*) FROM part) AS parts, (SELECT max(l_suppkey) + 1 FROM lineitem) AS supps),
cs AS (SELECT 2000000000 + ((l_orderkey * n.parts + l_partkey) * n.supps + l_suppkey) * 8 + l_linenumber AS node_id,
    l_partkey AS src, (l_orderkey * 7 + l_suppkey) % n.parts AS dst, CAST(l_linenumber AS BIGINT) AS line
  FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
    WHERE l_quantity >= 46 AND l_returnflag = '{flag}') AS l CROSS JOIN n),
nodes AS (SELECT CAST(p_partkey AS BIGINT) AS node_id, 'Function' AS kind, concat('part_', p_partkey) AS name,
    concat('c:@S@', p_brand, '@F@part_', p_partkey, '#') AS usr, CAST(p_partkey * 2 + 1 AS BIGINT) AS start_line,
    CAST(p_partkey * 2 + 1 + p_size AS BIGINT) AS end_line FROM part
  UNION ALL SELECT 1000000000 + CAST(substr(p_brand, 7) AS BIGINT), 'Class', p_brand, concat('c:@S@', p_brand), CAST(1 AS BIGINT), 1 + count(*)
  FROM part GROUP BY p_brand
  UNION ALL SELECT node_id, 'CallSite', concat('part_', dst), CAST(NULL AS VARCHAR(99)), line, line FROM cs),
edges AS (SELECT 1000000000 + CAST(substr(p_brand, 7) AS BIGINT) AS src, CAST(p_partkey AS BIGINT) AS dst, 'AstChild' AS kind FROM part
  UNION ALL SELECT src, node_id, 'AstChild' FROM cs UNION ALL SELECT node_id, dst, 'Call' FROM cs),
cg AS (SELECT DISTINCT src, dst FROM cs)
"""


def prelude(flag: str = "R") -> str:
    return PRELUDE.replace("{flag}", flag)


#: A call site's number in the SQL, and one in the same order where that does not fit into 64 bits: {most} are the rows of an order at most.
NUMBER = "2000000000 + ((l_orderkey * n.parts + l_partkey) * n.supps + l_suppkey) * 8 + l_linenumber"
RANKED = "2000000000 + l_orderkey * {most} + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber)"


def over_tables(spark: SparkSession, sf_dir: str, body: str, *names: str) -> tuple[DataFrame, ...]:
    """The named common table expressions of a body that begins with prelude(), over the tables of sf_dir.

    The numbers of call sites grow with the product of three keys. If the largest is beyond 64 bits, call sites are numbered
    by order and rank within it.
    """
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem")}
    for t in tables:
        body = body.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    body = body.replace("VARCHAR(99)", "STRING")
    row = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM {lineitem} WHERE " + body.split("WHERE ", 1)[1].split(")", 1)[0]
    last = spark.sql(f"SELECT max(struct(*)) AS row, (SELECT count(*) FROM {{part}}) AS parts, (SELECT max(l_suppkey) + 1 FROM {{lineitem}}) AS supps FROM ({row})", **tables).first()
    if last.row and 2000000000 + ((last.row[0] * last.parts + last.row[1]) * last.supps + last.row[2]) * 8 + last.row[3] >= 1 << 63:
        most = spark.sql(f"SELECT max(c) FROM (SELECT count(*) AS c FROM ({row}) GROUP BY l_orderkey)", **tables).first()[0]
        body = body.replace(NUMBER, RANKED.format(most=most))
    return tuple(spark.sql(f"WITH {body} SELECT * FROM {name}", **tables) for name in names)


def warehouse_graph(spark: SparkSession, sf_dir: str, flag: str = "R") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the derived graph; edges are raw, so Call edges start at call sites."""
    return over_tables(spark, sf_dir, prelude(flag), "nodes", "edges")
