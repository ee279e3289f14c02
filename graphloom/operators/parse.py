"""Files to facts: a table function for SQL and an Arrow batch job, both over the same parsers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.parsers import FACT_FIELDS, PARSE_ERRORS, parsed, registered
from graphloom.operators.heuristic import heuristic_facts
from graphloom.plans.ship import ship
from graphloom.schemas import FACTS, conform


class ParseSource:
    """parse_source(language, source): the facts of one text; a text that does not parse has none."""

    def eval(self, language: str, source: str) -> Iterator[tuple]:
        parser = registered().get(language)
        if parser is not None:
            yield from parsed(parser, source)[0]


def register_udtf(spark: SparkSession, name: str = "parse_source") -> None:
    """Make the table function known to SQL, for `FROM files, LATERAL parse_source(language, content)`."""
    ship(spark)
    spark.udtf.register(name, F.udtf(ParseSource, returnType=FACT_FIELDS))


_INTS = {"fact_id", "start_line", "start_col", "end_line", "end_col", "parent_id"}
#: Facts that become one Arrow batch.
_AT_ONCE = 10_000
_NAMES = [part.split(" ")[0] for part in FACT_FIELDS.split(", ")]


def grammar_facts(files: DataFrame) -> DataFrame:
    """Facts and errors of files (path, language, content) whose languages have a parser: FACTS and error.

    A file that does not parse is one row with an error and nothing else.
    """
    ship(files.sparkSession)
    parsers = registered()

    names = ["path", "language", *_NAMES, "error"]

    def packed(facts: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in _INTS else pa.string()) for n, c in zip(_NAMES, zip(*facts))], names=_NAMES)

    def of_file(path: str, language: str, source: str | None) -> Iterator[pa.RecordBatch]:
        """A file's facts are kept packed until it ends, as an error takes them all back."""
        try:
            facts = iter(parsers[language](source or ""))
            found, error = [packed(some) for some in iter(lambda: list(islice(facts, _AT_ONCE)), [])], None
        except PARSE_ERRORS as e:
            found, error = [packed([(None,) * len(_NAMES)])], f"{type(e).__name__}: {e}"
        while found:
            rows = found.pop()
            same = [pa.repeat(pa.scalar(value, pa.string()), rows.num_rows) for value in (path, language, error)]
            yield pa.RecordBatch.from_arrays([*same[:2], *rows.columns, same[2]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from of_file(*(c[k].as_py() for c in batch.columns))

    chosen = files.where(F.col("language").isin(list(parsers))).select("path", "language", "content")
    return chosen.mapInArrow(run, f"path string, language string, {FACT_FIELDS}, error string")


def parse_files(files: DataFrame, markup_filter: bool = True) -> tuple[DataFrame, DataFrame]:
    """(facts, errors) of files (path, language, content). Languages without a parser go through the token scan.

    All languages are kept; errors has (path, error).
    """
    rows = grammar_facts(files)
    scanned = heuristic_facts(files.where(~F.col("language").isin(list(registered()))), markup_filter)
    named = scanned.drop("language").join(files.select("path", "language"), "path")
    good = rows.where("error IS NULL").withColumn("source_file", F.col("path"))
    return conform(good, FACTS).unionByName(conform(named, FACTS)), rows.where("error IS NOT NULL").select("path", "error")
