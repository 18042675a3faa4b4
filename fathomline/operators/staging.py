"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def stage(df: DataFrame, label: str) -> DataFrame:
    """df written as a Parquet table below spark.checkpoint.dir and read again; an error where that is unset.

    Cuts the lineage: a lost executor costs only the reading of its splits.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{folder.rstrip('/')}/fathomline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
