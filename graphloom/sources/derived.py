"""Files and facts derived from the warehouse tables, so that sources and parsers can be checked with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.warehouse import over_tables, prelude

#: SQL of a path made of a document's source, id and an extension for its language.
DOCUMENT_PATH = "concat(source, '/', doc_id, CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.CPP' WHEN 'fr' THEN '.go' ELSE '.rb' END)"

#: Common table expressions of facts over part and cs: brands, parts by their (ambiguous) names, and call sites.
FACTS_SQL = """
fact AS (SELECT p_brand AS path, CAST(0 AS BIGINT) AS fact_id, 'Class' AS kind, p_brand AS name, CAST(1 AS BIGINT) AS start_line,
    1 + count(*) AS end_line, CAST(NULL AS BIGINT) AS parent_id FROM part GROUP BY p_brand
  UNION ALL SELECT p_brand, 1 + p_partkey, 'Function', p_name, p_partkey * 2 + 1, p_partkey * 2 + 1 + p_size, 0 FROM part
  UNION ALL SELECT a.p_brand, cs.node_id, 'CallSite', b.p_name, cs.line, cs.line, 1 + cs.src
    FROM cs JOIN part AS a ON a.p_partkey = cs.src JOIN part AS b ON b.p_partkey = cs.dst)
"""


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of the documents as if they were source files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.expr(DOCUMENT_PATH).alias("path"), F.col("text").alias("content"))


def derived_facts(spark: SparkSession, sf_dir: str, flag: str = "R") -> DataFrame:
    """Facts of the warehouse graph with the parts' names as symbols; many parts share a name."""
    (facts,) = over_tables(spark, sf_dir, f"{prelude(flag)}, {FACTS_SQL}", "fact")
    none = F.lit(None).cast("string")
    return facts.withColumns({"usr": none, "language": F.lit("Unknown"), "start_col": F.lit(0).cast("long"), "end_col": F.lit(0).cast("long"), "source_file": F.col("path")})


#: A file for each brand in several languages: how a class, a function and a call are written.
TEMPLATES = {
    "Python": ("class {c}:\n    x = 1\n{body}", "    def {f}(self):\n        pass\n{calls}", "        {t}()\n"),
    "CppTreeSitter": ("namespace demo {{\nclass {c} {{ public:\n{body}\n}};\n}}\n", "  int {f}(int a, const std::vector<int> &v = {{}}) {{\n    int n = 0, *p = &n;\n{calls}    return n;\n  }}\n", "    {t}(1);\n"),
    "Go": ("package demo\n\ntype {c} struct {{\n  a int\n}}\n{body}", "func {f}(a int) int {{\n{calls}  return 0\n}}\n", "  {t}(1)\n"),
    "Rust": ("struct {c} {{\n  a: i32,\n}}\n{body}", "fn {f}(a: i32) -> i32 {{\n{calls}  0\n}}\n", "  {t}(1);\n"),
    "Ruby": ("class {c}\n{body}end\n", "  def {f}\n{calls}  end\n", "    {t}(1)\n"),
}


def generated_files(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """(path, language, content): a source file for each brand, with its parts as functions and their calls."""
    from graphloom.sources.warehouse import warehouse_graph

    nodes, edges = warehouse_graph(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.replace("p_brand", F.lit("#"), F.lit("_")).alias("brand"))
    outer, inner, call = (t.replace("{{", "\1").replace("}}", "\2") for t in TEMPLATES[language])

    def filled(template: str, **values: F.Column) -> F.Column:
        out = F.lit(template)
        for name, value in values.items():
            out = F.replace(out, F.lit(f"{{{name}}}"), value)
        return out

    sites = edges.where("kind = 'AstChild'").join(edges.where("kind = 'Call'").select(F.col("src").alias("dst"), F.col("dst").alias("target")), "dst")
    line = filled(call, t=F.concat(F.lit("part_"), F.col("target").cast("string")))
    calls = sites.groupBy(F.col("src").alias("p_partkey")).agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("calls"))
    functions = part.join(calls, "p_partkey", "left").select(
        "brand", "p_partkey", filled(inner, f=F.concat(F.lit("part_"), F.col("p_partkey").cast("string")), calls=F.coalesce("calls", F.lit(""))).alias("body")
    )
    bodies = functions.groupBy("brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "body"))), lambda x: x["body"]), "").alias("body"))
    content = F.translate(filled(outer, c=F.col("brand"), body=F.col("body")), "\1\2", "{}")
    files = bodies.select(F.col("brand").alias("path"), F.lit(language).alias("language"), content.alias("content"))
    # By number, as few small files would else come to one task, and parsing takes longer than moving them.
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
