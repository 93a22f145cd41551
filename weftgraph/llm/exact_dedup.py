"""Exact deduplication by progressive refinement, in DataFrame functions only.

Rows are grouped by the length of their normalised text, then, where a length repeats, by
a hash of its prefix, then, where that repeats, by the full SHA-256. Texts are read where
they lie and never shuffled for grouping: a written thin row stands for each, and every
step narrows the thin rows of the one before by counts that tasks pre-aggregate. The digest
of a text is taken in the same scan, as the result names it for every document.

``deduplicate`` moves each text that stays once, to drop the others; repeats of a whole row
go within their task before that.

Defined cases: a null text counts as empty; an empty text equals every other one that is
empty or white space; among equal texts the row with the most code points stays, then the
smallest id, a null id last; of rows repeated in full one stays; an empty table gives an
empty result; further columns, whatever their names, are ignored here and kept by
``deduplicate``. Any 64-bit id may occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.scratch import stage

WHITE = " \t\n\x0b\f\r"
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """``text`` without its white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def points_of(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def thin_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One written row per document: its number here, id, points, size, prefix hash, digest."""
    base = docs.select(F.col(id_col).alias("id"), points_of(F.col(text_col)).alias("points"), normalised(F.col(text_col)).alias("body"))
    thin = base.select("id", "points", F.octet_length("body").alias("size"), F.xxhash64(F.substring("body", 1, prefix_chars)).alias("prefix"), F.sha2("body", 256).alias("digest"))
    return stage(thin.withColumn("row", F.monotonically_increasing_id()), "exact-rows")


def repeated(thin: DataFrame) -> DataFrame:
    """(digest, members, best) of every text that occurs more than once.

    ``best`` holds id and row of the one that stays. Lengths go first, then prefixes; only
    rows that survive both are grouped by digest.
    """
    counts = thin.groupBy("size", "prefix").count()
    lengths = counts.groupBy("size").agg(F.sum("count").alias("n")).where("n > 1").select("size")
    prefixes = counts.join(lengths, "size", "left_semi").where("count > 1").select("size", "prefix")
    survivors = thin.join(prefixes, ["size", "prefix"], "left_semi")
    first = F.min(F.struct((-F.col("points")).alias("less"), F.isnull("id").alias("last"), "id", "row"))
    return survivors.groupBy("digest").agg(F.count("*").alias("members"), first.alias("best")).where("members > 1")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, keep_id, group_size, kept and text_sha256."""
    thin = thin_rows(docs, id_col, text_col)
    groups = stage(repeated(thin).select("digest", "members", F.col("best.id").alias("best_id"), F.col("best.row").alias("best_row")), "exact-groups")
    grouped = F.col("members").isNotNull()
    return thin.join(groups, "digest", "left").select(
        F.col("id").alias(id_col),
        F.when(grouped, F.col("best_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("members", F.lit(1)).cast("long").alias("group_size"),
        (~grouped | (F.col("best_row") == F.col("row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _row_key(id_column: Column, points: Column, digest: Column) -> Column:
    """Names a row by all that decides whether it stays."""
    return F.concat_ws(":", F.coalesce(id_column.cast("string"), F.lit("")), points.cast("string"), digest)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    thin = thin_rows(docs, id_col, text_col)
    groups = stage(repeated(thin).select("digest", F.col("best.row").alias("best_row")), "exact-groups")
    stays = thin.join(groups, "digest", "left").where("best_row IS NULL OR best_row = row")
    keys = stays.select(_row_key(F.col("id"), F.col("points"), F.col("digest")).alias("key"))
    own = _row_key(F.col(id_col), points_of(F.col(text_col)), F.sha2(normalised(F.col(text_col)), 256))
    rows = docs.select(own.alias("key"), F.struct(F.col("*")).alias("whole"))
    return rows.dropDuplicates(["key"]).join(keys, "key", "left_semi").select("whole.*")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
r AS (
  SELECT doc_id, sha256(body) AS text_sha256,
         count(*) OVER (PARTITION BY body) AS group_size,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
         row_number() OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS n
  FROM d)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, text_sha256 FROM r
"""
