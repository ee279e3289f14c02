"""Intermediate tables that survive the loss of executors.

Lineage is cut by writing Parquet below the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver can read it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, a temporary one in local mode, as in tests, and an error elsewhere."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(named)
    return named


class Scratch:
    """Named Parquet tables in the checkpoint folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        """Write df and read it back; its plan then starts at the written files."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path, compression=codec)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self) -> None:
        """Let Spark delete the shuffle files of plans that nobody refers to any more, which else wait for the driver's memory to fill."""
        gc.collect()
        self.spark._jvm.System.gc()

    def clear(self) -> None:
        """Delete all tables that save() has written, of which nobody needs any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete the files of tables that save() returned and nobody needs any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for df in tables if df is not None for f in df.inputFiles()}:
            if "/scratch-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
