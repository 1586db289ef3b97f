"""Small results that several parts of a plan read, written once to the folder that the cluster shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir.

    On a single machine that names no such folder a temporary one is set; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tallyframe-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tallyframe-{os.getpid()}-{uuid.uuid4().hex}/{name}"


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt over all cores: a small file comes in one task, however dear the work on each of its rows is."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to a new shared folder and read back, so its plan runs once and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
