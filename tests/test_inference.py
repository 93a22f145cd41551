"""Golden cases of formula expressions and of the inference and review operators."""

from pyspark.sql import functions as F

from weftgraph.functions import expressions as X
from weftgraph.operators import inference as I


def one(spark, column, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"c {kind}").select(column(F.col("c"))).collect()]


def test_references_skip_strings_and_comments(spark):
    formula = "CALCULATE([Total], 'My ''T'''[Col] = \"[no] // x\", Sales[Qty]) // [gone]\n/* [too]\n[gone] */ + [Total] -- [x]"
    got = [(r["table"], r["name"]) for r in one(spark, X.references, formula)[0]]
    assert got == [(None, "Total"), ("My 'T'", "Col"), ("Sales", "Qty")]
    assert one(spark, X.references, "", None) == [[], None]


def test_function_classes(spark):
    assert one(spark, X.function_classes, 'if(HASONEVALUE(T[c]), Calculate([m], all(T)), "FORMAT(")', "SUM(T[c])") == [["selector", "filter_context", "conditional"], []]


def test_formula_key(spark):
    a, b, c = one(spark, X.formula_key, "SUM( 'Sales'[Qty] ) // note", "sum(Sales[Qty])", "sum('My Sales'[Qty])")
    assert a == b != c
    x, y = one(spark, X.formula_key, '"a b"', '"ab"')
    assert x != y


def test_text_and_guard(spark):
    assert one(spark, X.plain_text, "a  \r\nb\t\rc ", None) == ["a\nb\nc", None]
    assert one(spark, X.read_only, "EVALUATE updates", "select 1; drop table x", None) == [True, False, None]


def test_weights_take_the_longest_name(spark):
    assert one(spark, I.evidence_weight, "object_name", "dax_ast_walk", "Manual", "rumour", None, "x_report_usage") == [0.30, 0.86, 1.0, 0.15, 0.15, 0.48]


def test_roles_and_denials(spark):
    assert one(spark, I.role_from_text, "Order Date", "sku sales", "Invoices", None) == ["date_dimension", "product_dimension", None, None]
    assert one(spark, lambda c: I.denies(c, ["filter", "filtered"]), "It does not ever change the filter", "a filter", "not one two three four five six filter", None) == [True, False, False, False]


def test_scored_facts_are_capped(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id int")
    got = I.scored(ids(1, 2, 3), {"apart": (ids(1, 1), 0.25), "acts": (ids(1, 2), 0.40), "used": (ids(1), 0.40)})
    assert {r["id"]: (list(r["facts"]), r["score"]) for r in got.collect()} == {1: (["acts", "apart", "used"], 0.99), 2: (["acts"], 0.4), 3: ([], 0.0)}


def test_options_of_wide_owners_are_none(spark):
    rows = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), ("b", "1"), ("b", "2"), ("b", "3"), ("c", None)], "o string, v string")
    assert sorted(map(tuple, I.options(rows, "o", "v", 2).select("o", "ordinal", "v").collect())) == [("a", 1, "x"), ("a", 2, "y")]


def test_low_evidence(spark):
    data = [("Total_Sales", "[total sales]", "description", ["description"], 0.96), ("x", "y", "name", [], 0.3), ("x", "y", "dax", ["name", "object_name"], 0.9), ("x", "y", "dax", None, 0.2), ("x", "y", "dax", ["dax"], 0.2), (None, None, None, None, None)]
    df = spark.createDataFrame(data, "n string, v string, s string, e array<string>, c double")
    assert [r[0] for r in df.select(I.low_evidence(*map(F.col, "nvsec"))).collect()] == [True, True, True, True, False, False]


def test_decide_then_undo(spark):
    items = spark.createDataFrame([(1, "candidate"), (2, "rejected"), (3, None)], "id int, status string")
    done = I.decide(items, spark.createDataFrame([(1, "approved"), (9, "approved")], "id int, status string"))
    assert sorted(map(tuple, done.select("id", "status", "previous").collect())) == [(1, "approved", "candidate"), (2, "rejected", None), (3, None, None)]
    assert sorted(map(tuple, I.undo(done).select("id", "status").collect())) == [(1, "candidate"), (2, "rejected"), (3, None)]


def test_overlay_and_carry_over(spark):
    rows = spark.createDataFrame([(1, "a", "d"), (2, "b", None)], "id int, name string, note string")
    over = spark.createDataFrame([(1, "note", "new"), (1, "note", "newer"), (7, "note", "x")], "id int, property string, value string")
    assert sorted(map(tuple, I.overlay(rows, over, ["name", "note"]).collect())) == [(1, "a", "newer"), (2, "b", None)]
    s = lambda *v: spark.createDataFrame(list(v), "id int, status string")
    assert sorted(map(tuple, I.carry_over(s((1, "FACT"), (2, "FACT")), s((1, "approved"), (3, "rejected"))).collect())) == [(1, "approved"), (2, "FACT")]
