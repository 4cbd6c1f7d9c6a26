"""Intermediate tables written to the shared folder of the cluster.

A table that several later jobs read is written once as Parquet. That cuts its lineage,
survives the loss of executors, and gives the planner its true size. ``release`` removes
the tables of a session once nothing reads them any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "wellspring"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/{_PREFIX}-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has been written to."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table.

    ``by`` names a column of few values that gets one folder per value.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_buckets(df: DataFrame, name: str, buckets: int, keys: list[str]) -> DataFrame:
    """The same, dealt by ``keys`` into buckets that a join on them need not shuffle.

    Rows are placed before they are written, so that each bucket is one sorted file.
    """
    spark = df.sparkSession
    table = f"{_PREFIX}_{name}_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, *keys)
    writer = placed.write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", new_folder(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)


def release(spark: SparkSession) -> None:
    """Remove every table that this application has written to the shared folder."""
    for table in spark.catalog.listTables():
        if table.name.startswith(f"{_PREFIX}_"):
            spark.sql(f"DROP TABLE IF EXISTS `{table.name}`")
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
