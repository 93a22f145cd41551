"""The pipeline's stages, and queries with SQL against it."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import language_id
from weftgraph.llm.queries import ORACLE_SQL, QUERIES
from weftgraph.llm.scratch import stage

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, expected = QUERIES[name](spark, DATA), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(expected.select(*[f'"{c}"' for c in columns]).fetchall())


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "42 !", "en", "s", 4), (10**6 + 2, None, "en", "s", 0)], docs.schema)
    now, counts, columns = docs.unionByName(odd), [], docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        now = stage(step(spark, now, DATA), name.replace(" ", "-"))
        assert now.columns == columns
        counts.append(now.count())
    assert counts[0] == docs.count() and counts[0] > counts[1] >= counts[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, now, DATA)
    assert packed.where("start = 0").count() == counts[-1]


def test_run_on_no_documents(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_leaves_the_last_stages_tables_alone(spark):
    from weftgraph.llm import scratch

    before = set(os.listdir(scratch.shared_dir(spark)))
    result = corpus_pipeline.run(spark, DATA)
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(scratch.shared_dir(spark))) - before}
    assert left == {"mixing", "pieces"} and result.count() > 0


@pytest.mark.parametrize("lang", [None, "en"])
def test_language_stage_keeps_texts_with_letters_when_nothing_is_learned(spark, lang):
    rows = [(i, t, None) for i, t in enumerate(["some clean words", None, "", "12 ½ _ !", "één"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = spark.range(100, 200).where(language_id.held_out(F.col("id"))).selectExpr("id AS doc_id", "'held out text' AS text", f"{'NULL' if lang is None else repr(lang)} AS lang")
    kept = language_id.keep_identified(docs.union(ids))
    assert language_id.learn(docs.union(ids)) == [] and kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id < 100").collect()) == [0, 4] and kept.where("doc_id >= 100").count() == ids.count() > 0


def test_the_identified_language_decides_what_shares_a_sequence(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    unlabelled = docs.withColumn("lang", F.expr("CASE WHEN doc_id % 10 < 2 THEN NULL WHEN doc_id % 10 = 2 THEN 'en' ELSE lang END"))
    now = unlabelled
    for _, step in corpus_pipeline.STAGES[:-1]:
        now = stage(step(spark, now, DATA), "language-test")
    found = {r["doc_id"]: r["lang"] for r in now.select("doc_id", "lang").collect()}
    wrong = [i for i, lang in found.items() if lang != truth[i]]
    assert len(wrong) <= 0.02 * len(found) and len({*truth.values()}) > 1
    sequences = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, now, DATA).collect():
        sequences.setdefault(r["sequence_id"], set()).add(found[r["doc_id"]])
    assert all(len(langs) == 1 for langs in sequences.values()) and {lang for s in sequences.values() for lang in s} == set(found.values())
