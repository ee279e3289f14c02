"""Broadcast of tables whose size was counted first; batches of a size that long texts allow."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few integers up to which a counted table is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def counted(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The written table, marked for broadcast if it has no more rows than that."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Jobs that run in here hand rows of text to Python in batches of so many; the setting is put back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
