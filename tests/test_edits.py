"""Golden cases of the change plan operators."""

from pyspark.sql import functions as F

from weftgraph.operators import edits


def test_risk(spark):
    data = [("COLUMN", "description", "LOW"), ("COLUMN", "name", "HIGH"), ("MEASURE", "formula", "MEDIUM"), ("ROLE", "description", "CRITICAL"), ("MEASURE", "Data_Source", "CRITICAL")]
    df = spark.createDataFrame(data, "k string, p string, want string")
    assert [r[0] for r in df.select(edits.risk(F.col("k"), F.col("p"))).collect()] == [r[2] for r in data]
    assert df.agg(edits.highest(F.col("want"))).first()[0] == "CRITICAL" and df.limit(0).agg(edits.highest(F.col("want"))).first()[0] is None


def test_rename_clashes_with_kept_and_new_names(spark):
    rows = spark.createDataFrame([(1, "a_x", "t"), (2, "A", "t"), (3, "b_x", "t"), (4, "b", "u"), (5, None, "t")], "id int, name string, t string")
    assert sorted(map(tuple, edits.rename_preview(rows, "_x$", "", ["t"]).collect())) == [(1, "a_x", "a", True), (3, "b_x", "b", False)]


def test_policies_and_donors(spark):
    gone = spark.createDataFrame([(1, "block"), (2, "cascade"), (3, "repoint"), (4, "block")], "item int, policy string")
    uses = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("a", 3)], "owner string, item int")
    assert sorted(map(tuple, edits.outcome(gone, uses, F.col("policy")).collect())) == [(1, 1, "blocked"), (2, 2, "remove_all"), (3, 1, "repoint"), (4, 0, "remove")]
    donors = spark.createDataFrame([("x", "1"), ("x", None), ("y", "1"), ("y", "1")], "k string, v string")
    assert [tuple(r) for r in edits.disagreeing(donors, "k", "v").collect()] == [("x", 2)]


def test_deletions_run_backwards(spark):
    steps = spark.createDataFrame([("delete", 0, "a"), ("delete", 1, "b"), ("create", 1, "d"), ("create", 0, "c")], "phase string, layer int, id string")
    assert [r["id"] for r in edits.step_order(steps, ["create", "delete"]).collect()] == ["c", "d", "b", "a"]
