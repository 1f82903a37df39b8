"""Written intermediates: stage boundaries, loop rounds and shared sub-plans."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it gets a temporary folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints", f"cadastra-{uuid.uuid4().hex}")
    os.makedirs(own)
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df and read it back: later plans start from files, which outlive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
