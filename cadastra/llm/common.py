"""What the operators of this subpackage share: table reading, staged intermediates, null-safe text."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_root(spark: SparkSession) -> str:
    """The shared folder for intermediates: spark.checkpoint.dir where the cluster names one.

    Without the setting only a local session is served (tests, one machine); it gets a temporary folder
    that goes when the driver ends. A cluster without the setting is an error, as no machine-local
    folder is visible to all of its executors.
    """
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


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"


def reread(spark: SparkSession, path: str, schema) -> DataFrame:
    """A written table; the schema is given, so that reading it starts no job and an empty one works."""
    return spark.read.schema(schema).parquet(path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = reread(spark, path, df.schema)
    out._staged_path = path
    return out


def file_place() -> Column:
    """Sorts the rows of a written table as they were written: by the task that wrote the file, its files, the row.

    For a table as read, before any join; reading alone deals files to tasks by size.
    """
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0))
    return F.struct(number(r"^part-(\d+)").alias("task"), number(r"-c(\d+)\.").alias("file"), F.col("_metadata.row_index").alias("row"))


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(df, "_staged_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z only: lower() would also fold letters outside ASCII."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: the split between training and held-out documents."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


#: Bytes of whole texts that go to a Python worker at once; one longer document is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_texts(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """rows.mapInArrow for rows of whole texts, with bounded memory.

    Batches are bounded by bytes (a smaller bound of the session stays), not only by rows, and a worker gives
    back what a task has freed: workers outlive tasks, and two of them share an executor with its JVM.
    """
    spark = rows.sparkSession
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_KEY)) > BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows.mapInArrow(tidy, schema)


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_STATE: dict[Hashable, object] = {}


def worker_state(key: Hashable, build: Callable[[], object]) -> object:
    """What a worker keeps from task to task: the tables of one operator, those used last."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = build()
    return _STATE[key]
