"""The corpus pipeline: stages that turn ``documents`` into packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from weftgraph.llm.scratch import discard, importable, made, stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, which ``lang`` names from then on; null texts and texts without a letter go."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the one with the most code points, then the smallest id."""
    return exact_dedup.deduplicate(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shared five-word shingles at 0.8 or more, one row: the smallest id, then the smallest row key."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of the packed sequences, each of which holds texts of one identified language."""
    return packing.pack(docs, packing.default_vocabulary(), apart_col="lang")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Best-fit packing and rank-order profiles are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread as the next one's input; then what it was made of is deleted."""
    importable(spark)
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, start)
    return STAGES[-1][1](spark, docs, sf_dir)
