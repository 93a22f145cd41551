"""Tables written between the steps of an operator.

They go to the folder that the cluster names in ``spark.checkpoint.dir``, which every
executor can read, so a lost executor costs no more than the tasks it was running.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one, deleted at exit, only where none is set and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-weft-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return it as reread from there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """``stage``, in as many buckets of ``key`` as the session shuffles into, so that joins by it leave these rows where they are."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path, buckets = f"{shared_dir(spark)}/{table}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(table)
    _MADE.append(path)
    return spark.table(table)


def made() -> int:
    """How many tables have been staged so far."""
    return len(_MADE)


def discard(spark: SparkSession, since: int) -> None:
    """Deletes what was staged after the first ``since`` tables but the newest, of which all that is needed went into that."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in _MADE[since:-1]:
        where = files.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del _MADE[since:-1]


def give_back() -> None:
    """Return memory that a Python worker has freed, for workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


_CACHES: dict[str, Callable[[], None]] = {}


def remembers(name: str, clear: Callable[[], None]) -> None:
    """What a module keeps between the tasks of a worker, and how it forgets that."""
    _CACHES[name] = clear


def forget(*but: str) -> None:
    """Drops what other operators have left in this worker, which may serve one after another."""
    for name, clear in _CACHES.items():
        if name not in but:
            clear()
    give_back()


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where only the driver's path names it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *env.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
