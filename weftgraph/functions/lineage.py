"""Cutting the lineage of iterative plans through the shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rounds that are read side by side before they are written as one.
MOST_ROUNDS = 16


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one, deleted at exit, only if none is set and Spark runs in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="spark-weft-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder and read back, so its true size is known to joins."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """As ``cut``, and ``what`` (the number of rows) as seen while writing, so that no job asks for it."""
    seen = Observation()
    written = cut(df.observe(seen, (F.count(F.lit(1)) if what is None else what).alias("n")))
    return written, seen.get["n"]


class Rounds:
    """What rounds have found so far. A round is written once and appended; earlier ones are not written again but now and then as one.

    ``added`` is the number of rows of the last round.
    """

    def __init__(self, first: DataFrame):
        new, self.added = counted(first)
        self.frames = [new]

    def add(self, found: DataFrame) -> DataFrame:
        """Writes one more round and returns it."""
        new, self.added = counted(found)
        self.frames.append(new)
        if len(self.frames) > MOST_ROUNDS:
            self.frames = [cut(self.all())]
        return new

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.frames)
