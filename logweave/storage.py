"""Tables that outlive executors: written to the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; one of our own only in local mode, where that is unset."""
    key = "spark.checkpoint.dir"
    where = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {key} to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="logweave-")
        spark.conf.set(key, where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a lost executor costs a reread, not the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
