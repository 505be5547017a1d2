"""Cutting the lineage of iterative plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one in the warehouse if all executors reach it, as in a local session.

    On a cluster a warehouse on the driver's own disk is no such folder: then spark.checkpoint.dir must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        where = spark._jvm.org.apache.hadoop.fs.Path(warehouse)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/_trajecta"


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
