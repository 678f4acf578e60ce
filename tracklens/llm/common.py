"""What the training-data operators share: staged tables, Arrow batches, text helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; our own where it is unset and all run on this machine."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if path is None:
        found = sc._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if path is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tracklens-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The table stays until ``discard`` or ``discard_all``, or the session's end: a plan may read it at any time.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd" if name.startswith("z_") else "snappy").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    _staged.add(path)
    return out


_staged: set[str] = set()


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that no plan will read any more."""
    for t in tables:
        if path := getattr(t, "_staged_at", None):
            p, fs = _path(t.sparkSession, path)
            fs.delete(p, True)
            _staged.discard(path)


def discard_all(spark: SparkSession) -> None:
    """Remove all staged tables of this driver, once the results that were made of them are written: for long sessions."""
    for path in sorted(_staged):
        p, fs = _path(spark, path)
        fs.delete(p, True)
    _staged.clear()


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, as texts may be long; a session's own settings stay."""
    for key, value in (("maxRecordsPerBatch", "1000"), ("maxBytesPerBatch", str(32 << 20))):
        key = "spark.sql.execution.arrow." + key
        if spark.conf.get(key) == _DEFAULTS.setdefault(key, spark._jvm.org.apache.spark.sql.internal.SQLConf().getConfString(key)):
            spark.conf.set(key, value)


_DEFAULTS: dict[str, str] = {}


_kept: dict = {}
try:
    _trim = ctypes.CDLL(None).malloc_trim  # glibc only
except (AttributeError, OSError):
    _trim = None


def kept(key: tuple, make):
    """What a Python worker keeps between tasks, such as a cache of words: one thing at a time, which bounds its memory.

    Called at the start of a task; memory that earlier tasks have freed goes back to the system.
    """
    if key not in _kept:
        _kept.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def partitions(spark: SparkSession, *tables: DataFrame, times: int = 1, each: int = 128 << 20) -> int:
    """Partitions of an explicit shuffle: the session's, or more where Spark's estimate of the tables, ``times`` over, is above ``each`` bytes a partition."""
    size = sum(int(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for t in tables) * times
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // each, 1_000_000))
