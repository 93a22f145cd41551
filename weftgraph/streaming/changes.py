"""Streams of change records: counts per event-time window, and the class of each record against the last one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.keys import fingerprint


def read_table(spark: SparkSession, sf_dir: str, name: str, files_a_batch: int = 1000) -> DataFrame:
    """A Parquet table as a stream of its files; new files join it as they come."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{path}*")


def windowed(stream: DataFrame, ts: str, by: list[str], length: str, late: str | None = None) -> DataFrame:
    """(start, *by, n): events per window; with ``late``, those later than that behind the newest are dropped and old windows' state freed."""
    timed = stream.withWatermark(ts, late) if late else stream
    return timed.groupBy(F.window(ts, length).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


@dataclass(frozen=True)
class Changes:
    """A stream of (key, order, __print) whose classes ``drain`` tells."""

    rows: DataFrame
    key: str
    order: str

    def told(self, records: DataFrame) -> DataFrame:
        last = Window.partitionBy(self.key).orderBy(self.order, "__print")
        status = F.when(F.row_number().over(last) == 1, "NEW").when(F.col("__print") == F.lag("__print").over(last), "UNCHANGED").otherwise("CHANGED")
        return records.select(self.key, self.order, status.alias("status"))


def classify(stream: DataFrame, key: str, order: str, values: list[str]) -> Changes:
    """(key, order, status): NEW, CHANGED or UNCHANGED against the key's record before it by ``order``, in whatever batch either came.

    A fingerprint a record is kept, as a record that comes late changes the class of the one behind it. Null keys are left out.
    """
    return Changes(stream.where(F.col(key).isNotNull()).select(key, order, fingerprint(*map(F.col, values)).alias("__print")), key, order)


def drain(result: DataFrame | Changes, out: str, checkpoint: str, mode: str = "append", seconds: int = 3600) -> None:
    """Runs a stream over all that is there now and writes Parquet; ``complete`` results and changes replace what stood before.

    Records of changes gather under ``checkpoint``, a folder a batch, and are classed once when the stream has run.
    """
    stream, records = (result.rows if isinstance(result, Changes) else result), f"{checkpoint}/records"
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if isinstance(result, Changes):
        run = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{records}/{n:08d}")).start()
    elif mode == "complete":
        run = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    else:
        run = writer.format("parquet").option("path", out).start()
    if not run.awaitTermination(seconds):
        run.stop()
        raise TimeoutError(f"stream still running after {seconds} seconds")
    if isinstance(result, Changes):
        result.told(stream.sparkSession.read.schema(stream.schema).parquet(f"{records}/*")).write.mode("overwrite").parquet(out)
