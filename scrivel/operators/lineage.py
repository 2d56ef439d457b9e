"""Written tables in the folder that all executors share, where a plan is iterated."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset and everything runs on one machine, a temporary folder; elsewhere that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='scrivel-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table that is read again: its lineage ends there, and lost executors lose none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scrivel/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
