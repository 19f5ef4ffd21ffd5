"""Readers of the driver's tables, by Spark's own reader only, and the cluster's shared folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch of texts.
ROWS_AT_ONCE = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_in_small_batches(spark: SparkSession, rows: int = ROWS_AT_ONCE) -> None:
    """Bound the rows that one Arrow batch of the session has; with whole texts Spark's default of 10,000 fills workers' memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def without(df: DataFrame, *names: str) -> DataFrame:
    """A table without its own columns of these names, for an operator that adds such columns."""
    taken = {n.lower() for n in names}
    return df.select([f"`{c}`" for c in df.columns if c.lower() not in taken])


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session, as in tests, may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or "/tmp/tidewire-checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """A new name for tables of one run in the shared folder."""
    return f"{checkpoint_folder(spark)}/tidewire-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def forget(spark: SparkSession) -> None:
    """Have the driver collect plans that are done with, so that Spark deletes their shuffle files now and not some time later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Written tables of one run in the shared folder: they cut lineage, and each goes once its successors are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, shared_folder(spark), {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Write a table and read it."""
        path = f"{self.folder}/{len(self.paths)}"
        df.write.option("parquet.block.size", 16 << 20).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read any more; others than those kept here are left alone."""
        for name, _ in (self.paths[id(x)] for x in tables if id(x) in self.paths):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
