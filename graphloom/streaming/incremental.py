"""Facts kept up to date by a file-source stream: each micro-batch parses the contents that are new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from graphloom.functions.languages import language_of
from graphloom.operators.parse import parse_files
from graphloom.sources.cache import FactCache
from graphloom.sources.files import as_files


def source_stream(spark: SparkSession, root: str) -> DataFrame:
    """(path, raw) of files as they appear below root."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root).select("path", F.col("content").alias("raw"))


def keep_facts(stream: DataFrame, cache: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Parse every new content into the fact cache. A batch that is run again finds its contents stored and adds nothing."""

    def update(batch: DataFrame, _: int) -> None:
        files = as_files(batch.withColumn("language", language_of(F.col("path"), strict=True)).where("language <> 'Unknown'"))
        FactCache(batch.sparkSession, cache).parsed(files, parse_files)

    writer = stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
