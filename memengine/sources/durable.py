"""Cuts the lineage of intermediates that later steps read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local master without one gets its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="memengine-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Spark's setting to remove shuffle files at the end of a query.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, clean: bool = False) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back, so that its true size is known; with ``clean``,
    what was shuffled for it is removed once it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/durable-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true" if clean else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
