"""What the operators of this subpackage share: work tables in the shared folder, checked broadcasts, text patterns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, and what stands between it.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a join side up to which it is broadcast; larger sides are joined by a shuffle with adaptive skew handling.
BROADCAST_ROWS = 200_000
BROADCAST_KEYS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set (tests on one machine), a temporary folder is made and set as the checkpoint folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for a work table or folder, with the scheme of its file system; its content outlives any executor."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def save(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: cuts the lineage, each text is worked on once."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it was counted and is small enough; else as it is, for a shuffled join. df should be a saved table."""
    return F.broadcast(df) if df.count() <= rows else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_bucket(name: str, n: int) -> Column:
    """crc32 of an id written as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % n


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keeps Arrow batches of whole texts small in rows and bytes, so that a worker's memory does not follow the length of texts.

    The setting is the session's, as plans read it when they run; a smaller one of the caller's stays.
    """
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= value:
            spark.conf.set(key, str(value))


_KEPT: dict = {}


def kept(name: str, make: Callable):
    """What a worker keeps under a name from task to task, made anew where it has something else.

    A worker lives through all operators of a pipeline: it keeps one thing at a time, and gives the memory of the one before back to the system.
    """
    if name not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
            trim(0)
        _KEPT[name] = make()
    return _KEPT[name]


def open_fs(uri: str):
    """(file system, path) of a folder in any store that pyarrow knows, given with its scheme."""
    from pyarrow import fs

    if ":" not in uri:
        raise ValueError(f"{uri} names no file system: Spark and pyarrow might take it for different places")
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)
