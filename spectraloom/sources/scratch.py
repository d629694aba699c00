"""Tables on the way: written to a folder that the driver and all executors share, and read back."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; local mode has a folder of its own where that is unset, a cluster has none."""
    said = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if said is None and (d := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        said = d.get()
    if said is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        said = "/tmp/checkpoints"
    return said.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df from the shared folder: what follows neither depends on its lineage nor computes it again."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
