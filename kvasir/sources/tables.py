"""Reading the tables of a directory and cutting lineage in the shared folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``, one Parquet file or a folder of them."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's own setting, else one under the warehouse (tests only)."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(CHECKPOINT_SETTING)
    if not folder:
        folder = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_shared")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, with its lineage cut, so that lost executors don't lose it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose rows are costly to work on, dealt out to all cores if it has fewer partitions than these.

    That is so for small files alone; a large table has more partitions than cores and stays as it is, unshuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.rdd().getNumPartitions() < cores else scan
