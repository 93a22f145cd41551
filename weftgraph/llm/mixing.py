"""Mixing sources to target weights, in DataFrame functions only.

Words are summed per source; each source's target follows from its weight and from a cap
on repetition; its rate is target over size. A document is taken floor(rate) times, and
once more if a draw seeded by its id and text falls under the fraction.

Defined cases: a null text has size 0; a null source is a source of its own, the last in
order; a source of size 0 has target 0 and its documents are not taken; a null id draws as
the empty id; rows that repeat id and text share their draw; an empty table gives an empty
result; further columns, whatever their names, are kept by ``mix``. The only window without a key is over the table of sources, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_column: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on id, text and seed alone; ids may be null or repeat, so the text counts too."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """Per source of ``sizes`` (source, source_size): target and rate.

    Shares by weight, where no target exceeds ``most_times`` its source's size, have the form
    least(cap, level * weight). Taken by rising cap per weight, the level that would hold if
    just the sources before were at their caps rises up to the true one and falls after it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    everything = Window.partitionBy()
    place = sizes.withColumn("place", F.row_number().over(by_name))
    weighed = place.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most_times)
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = weighed.withColumn("level", (F.sum("source_size").over(everything) - before).cast("double") / rest)
    return levels.withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight"))).select(
        "source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")
    )


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES, seed: str = SEED) -> DataFrame:
    """Per document: its id, size, source_size, target, copies and taken."""
    thin = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw(F.col(id_col), F.col(text_col), seed).alias("draw"))
    aims = targets(thin.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_times).withColumnRenamed("source", "aim_of")
    whole = F.floor("rate").cast("long")
    return (
        thin.join(aims, thin["source"].eqNullSafe(aims["aim_of"]))
        .withColumn("copies", whole + F.when(F.col("draw") < F.col("rate") - whole, 1).otherwise(0))
        .select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(word_count(F.col(text_col))).alias("source_size"))
    aims = targets(sizes, weights, most_times).select(F.col("source").alias("aim_of"), "rate")
    rows = docs.select(F.col(source_col).alias("from"), draw(F.col(id_col), F.col(text_col), seed).alias("draw"), F.struct(F.col("*")).alias("whole"))
    times = F.floor("rate").cast("int")
    copies = times + F.when(F.col("draw") < F.col("rate") - times, 1).otherwise(0)
    joined = rows.join(aims, rows["from"].eqNullSafe(aims["aim_of"]))
    return joined.select("whole", F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).select("whole.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH thin AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS digest,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM thin GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sizes),
weighed AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM placed),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
aims AS (SELECT *, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM aims),
taken AS (
  SELECT t.doc_id, t.size, r.source_size, r.target,
         (floor(r.rate) + CASE WHEN ('0x' || substr(t.digest, 1, 12))::BIGINT / 281474976710656.0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM thin t JOIN rated r ON t.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM taken
"""
