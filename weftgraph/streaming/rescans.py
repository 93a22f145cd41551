"""Rescans that touch only what changed: keyed state in buckets, edges recomputed for invalidated objects alone.

The state is four tables, each dealt into buckets by a hash of its key: objects by id, names by name, references by the name that
is referred to, edges by the object that refers. A batch of records reads and rewrites only the buckets that its keys fall in; a
bucket's rows are written under the batch's number, and a list of the buckets' numbers, written last, makes the batch valid. A batch
that is run again gives the same state, so a stream may repeat it after a failure.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.keys import fingerprint, fold
from weftgraph.functions.lineage import cut

BUCKETS = 64
#: Bracketed names in a formula.
REFERENCE = r"\[([^\[\]]+)\]"
TABLES = {"objects": ("id string, name string, formula string, digest string", "id"), "names": ("name string, id string", "name"), "references": ("name string, from_id string", "name"), "edges": ("from_id string, name string, to_id string", "from_id")}
STATUS = "id string, status string"


@dataclass(frozen=True)
class State:
    """The state at ``path``; the number of buckets is fixed when the first batch is written."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _at(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _listed(self, batch: int) -> dict[tuple[str, int], int]:
        """Which batch wrote each bucket last, before ``batch``: at most a row for each table and bucket."""
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = files.Path(f"{self.path}/lists")
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return {}
        done = [int(s.getPath().getName()) for s in system.listStatus(folder) if system.exists(files.Path(s.getPath(), "_SUCCESS"))]
        before = [n for n in done if n < batch]
        if not before:
            return {}
        return {(r["table"], r["bucket"]): r["batch"] for r in self.spark.read.schema("table string, bucket int, batch int").parquet(f"{self.path}/lists/{max(before)}").collect()}

    def read(self, table: str, listed: dict[tuple[str, int], int], touched: set[int] | None = None) -> DataFrame:
        """The rows of a table, or of its ``touched`` buckets."""
        paths = [f"{self.path}/{table}/bucket={b}/batch={n}" for (t, b), n in sorted(listed.items()) if t == table and (touched is None or b in touched)]
        schema = TABLES[table][0]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def now(self, table: str) -> DataFrame:
        return self.read(table, self._listed(1 << 62))

    def touched(self, *keys: DataFrame) -> set[int]:
        """The buckets of some keys; at most ``buckets`` numbers."""
        return {r["b"] for df in keys for r in df.select(self._at(F.col(df.columns[0])).alias("b")).distinct().collect()}

    def write(self, table: str, rows: DataFrame, touched: set[int], batch: int) -> dict[tuple[str, int], int]:
        """Writes the touched buckets anew; a bucket without rows gets none, and is read as empty."""
        if not touched:
            return {}
        key = TABLES[table][1]
        dealt = rows.withColumn("bucket", self._at(F.col(key))).repartition("bucket")
        staged = f"{self.path}/{table}"
        writer = dealt.withColumn("batch", F.lit(batch)).write.partitionBy("bucket", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite")
        writer.parquet(staged)
        held = {r["bucket"] for r in self.spark.read.parquet(staged).where((F.col("batch") == batch) & F.col("bucket").isin(sorted(touched))).select("bucket").distinct().collect()} if self._any(staged) else set()
        return {(table, b): batch if b in held else -1 for b in touched}

    def _any(self, folder: str) -> bool:
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = files.Path(folder)
        return any(s.isDirectory() for s in path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path))


def references_of(rows: DataFrame) -> DataFrame:
    """(name, from_id) of the names in the formulas of ``rows`` (id, formula), folded, each once."""
    return rows.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("formula", F.lit(REFERENCE), 1), fold))).alias("name"), F.col("id").alias("from_id"))


def resolved(references: DataFrame, names: DataFrame) -> DataFrame:
    """(from_id, name, to_id): each reference with the smallest id of that name; one that nothing bears has no edge."""
    return references.join(names.groupBy("name").agg(F.min("id").alias("to_id")), "name").select("from_id", "name", "to_id")


def rescan(state: State, records: DataFrame, batch: int) -> DataFrame:
    """(id, status) of the objects that a batch touches: NEW, CHANGED, UNCHANGED, DELETED, and INVALIDATED for those whose edges may have changed with others.

    ``records`` (id, name, formula, deleted) hold at most one record an id, the object as it is now; null ids are left out. An object refers by name. A
    name that came, went or moved invalidates what refers to it, wherever that is; only those edges, and those of the batch's own
    objects, are computed again. Buckets that no such key falls in are neither read nor written.
    """
    listed = state._listed(batch)
    new = cut(records.where("id IS NOT NULL").select("id", fold(F.col("name")).alias("name"), "formula", F.coalesce("deleted", F.lit(False)).alias("deleted"), fingerprint(F.col("name"), F.col("formula")).alias("digest")))
    at_ids = state.touched(new.select("id"))
    before = cut(state.read("objects", listed, at_ids))
    old = before.join(new.select("id"), "id", "left_semi")
    both = new.join(old.select("id", F.col("name").alias("old_name"), F.col("formula").alias("old_formula"), F.col("digest").alias("old_digest")), "id", "left")
    gone = F.col("deleted")
    status = F.when(gone & F.col("old_digest").isNull(), "UNCHANGED").when(gone, "DELETED").when(F.col("old_digest").isNull(), "NEW").when(F.col("old_digest") == F.col("digest"), "UNCHANGED").otherwise("CHANGED")
    told = cut(both.withColumn("status", status))
    moved = cut(told.where("status <> 'UNCHANGED'"))
    live = moved.where("NOT deleted")
    ids = moved.select("id")

    named = moved.where("deleted OR old_name IS NULL OR NOT (name <=> old_name)")
    names = cut(named.select(F.explode(F.array_compact(F.array("old_name", F.when(~gone, F.col("name"))))).alias("name")).distinct())
    own_refs = cut(references_of(live))
    lost_refs = references_of(moved.where("old_formula IS NOT NULL").select("id", F.col("old_formula").alias("formula")))
    asked = cut(own_refs.select("name").union(lost_refs.select("name")).union(names).distinct())  # names that are looked up or whose readers change
    at_names = state.touched(asked)
    known = cut(state.read("names", listed, at_names))
    names_now = cut(known.join(ids, "id", "left_anti").unionByName(live.where("name IS NOT NULL").select("name", "id").join(asked, "name", "left_semi")).unionByName(known.join(moved.where("NOT deleted AND old_name <=> name").select("id"), "id", "left_semi").join(asked, "name", "left_anti")).distinct())
    readers = cut(state.read("references", listed, at_names))
    refs_now = cut(readers.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").unionByName(own_refs))

    stale = cut(refs_now.join(names, "name", "left_semi").unionByName(own_refs).distinct())  # references whose edge is computed again
    at_edges = state.touched(stale.select("from_id"), ids)
    kept = state.read("edges", listed, at_edges).join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(names, "name", "left_anti")
    edges = kept.unionByName(resolved(stale, names_now))
    objects = before.join(ids, "id", "left_anti").unionByName(live.select("id", "name", "formula", "digest"))

    wrote: dict[tuple[str, int], int] = {}
    for table, rows, touched in (("objects", objects, at_ids), ("names", names_now, at_names), ("references", refs_now, at_names), ("edges", edges, at_edges)):
        wrote |= state.write(table, rows, touched, batch)
    lists = {k: n for k, n in (listed | wrote).items() if n >= 0}
    state.spark.createDataFrame([(t, b, n) for (t, b), n in lists.items()], "table string, bucket int, batch int").coalesce(1).write.mode("overwrite").parquet(f"{state.path}/lists/{batch}")
    invalid = stale.select(F.col("from_id").alias("id")).distinct().join(ids, "id", "left_anti").select("id", F.lit("INVALIDATED").alias("status"))
    return told.select("id", "status").unionByName(invalid)


def rescans(stream: DataFrame, state: State, checkpoint: str, out: str, seconds: int = 3600) -> None:
    """Applies a stream of records batch by batch, over all that is there now; each batch's statuses go to ``out``, a folder a batch."""

    def one(batch: DataFrame, number: int) -> None:
        rescan(state, batch, number).write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start()
    if not run.awaitTermination(seconds):
        run.stop()
        raise TimeoutError(f"stream still running after {seconds} seconds")
