"""Names and texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def readable_name(name: Column) -> Column:
    """The part after the last @, up to the first #; a name without @ is left alone."""
    return F.when(F.instr(name, "@") > 0, F.substring_index(F.substring_index(name, "@", -1), "#", 1)).otherwise(name)


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """Readable names for all nodes, and readable usr for functions and classes whose usr begins with c:."""
    symbol = F.col("kind").isin("Function", "Class") & F.startswith("usr", F.lit("c:"))
    return nodes.withColumn("name", readable_name(F.col("name"))).withColumn("usr", F.when(symbol, readable_name(F.col("usr"))).otherwise(F.col("usr")))


def fact_key(usr: Column, name: Column) -> Column:
    """What identifies a symbol."""
    return F.coalesce(usr, name, F.lit(""))


def strip_comments(text: Column) -> Column:
    """Comment marks become blanks; the text of comments stays."""
    for mark in ("//", "/*", "*/"):
        text = F.replace(text, F.lit(mark), F.lit(" "))
    return text


def looks_like_markup(text: Column) -> Column:
    return F.startswith(text, F.lit("<html")) | F.startswith(text, F.lit("<?xml")) | F.startswith(text, F.lit("<!DOCTYPE"))


def entry_list(text: str) -> list[str]:
    """Entry points from a comma-separated list."""
    return [part.strip() for part in text.split(",")]


def plausible_identifier(name: Column, cpp: bool = False) -> Column:
    """Whether a name looks hand-written rather than generated: a letter, or letters, digits and underscores of moderate length."""
    body = r"\A[A-Za-z_~][A-Za-z0-9_:~]*\z" if cpp else r"\A[A-Za-z_][A-Za-z0-9_]*\z"
    letter = F.rlike(name, F.lit(r"\A[A-Za-z]\z"))
    generated = F.rlike(name, F.lit(r"_1_1|_8cpp|_8h|\Aclass[A-Z]")) | ((F.length(name) > 40) & F.contains(name, F.lit("_"))) | (F.startswith(name, F.lit("dir_")) & (F.length(name) > 30))
    usual = (F.length(name) > 1) & F.rlike(name, F.lit(body)) & ~generated
    return letter | usual | (F.contains(name, F.lit("::")) if cpp else F.lit(False))
