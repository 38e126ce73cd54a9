"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a session on one machine may lack that setting; it gets a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("luxtrace.local.dir", "") or "file://" + tempfile.mkdtemp(prefix="luxtrace-")
        spark.conf.set("luxtrace.local.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written and read again: its lineage ends, and a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*done: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``done``, once nothing that is still to run reads it."""
    for df in done:
        spark = df.sparkSession
        for f in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
