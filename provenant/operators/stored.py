"""Intermediate tables, written so that plans stay small and nothing is computed twice."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of its own for a local run, an error for a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return base


class Stored:
    """Tables written on the way to a result; drop() deletes them when that result is written itself."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = []
