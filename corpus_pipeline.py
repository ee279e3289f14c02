"""The corpus pipeline: every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bounded import counted
from graphloom.llm.decontam import contamination
from graphloom.llm.jaccard import jaccard_components
from graphloom.llm.linededup import line_dedup
from graphloom.llm.packing import pack_buckets
from graphloom.llm.quality import line_quality
from graphloom.plans.scratch import Scratch

#: SQL cannot express SimHash groups or the dynamic programme; tests compare with brute force instead.
ORACLE_SQL = None


def _with_text(judged: DataFrame, columns: list[str]) -> DataFrame:
    """The input columns with the cleaned text, and n_chars following it where there is such a column."""
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return judged.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of the given doc_ids."""
    gone = Scratch(docs.sparkSession).save(gone.select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"))  # columns of docs may have any names
    return rows.join(counted(gone), F.col("own_id") == F.col("gone_id"), "left_anti").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that are rejected go."""
    return _with_text(line_quality(docs).where("kept"), docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each group of similar lines stays; every document stays with what is left of it."""
    return _with_text(line_dedup(docs), docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component stays; rows of one doc_id are one document."""
    return _without(docs, jaccard_components(docs).where("component_id <> doc_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return _without(docs, contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and slot of every document that is left."""
    return pack_buckets(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
