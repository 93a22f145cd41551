"""Golden cases of regression by place, validation, impact rules, formulas, search, plans and profiles."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import expressions, keys
from weftgraph.operators import align, analysis, comparing, components, formulas, inference, planning, profiles, regression, safety, search, traversal, validation


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_regression_by_place(spark):
    t = lambda *v: spark.createDataFrame(list(v), "k int, v double, s string")
    a = t((1, 1.0, "x"), (2, None, "y"), (2, 3.0, None))
    one = lambda b, mode="EXACT", **kw: regression.regression(a, b, mode, ["k", "v"], **kw).first()
    same = one(t((2, 3.0, None), (1, 1.0, "x"), (2, None, "y")))
    assert same["status"] == "PASSED" and not same["changed"] and same["before_hash"] == same["after_hash"]
    assert one(t((1, 1.0, "X"), (2, None, "y"), (2, 3.0, None)))["cells_failed"] == 1
    assert one(t((1, 1.0, "X"), (2, None, "y"), (2, 3.0, None)), fold=True)["status"] == "PASSED"
    near = t((1, 1.0, "x"), (2, None, "y"), (2, 3.4, None))
    assert one(near, "NUMERIC_TOLERANCE", relative=0.2)["status"] == "PASSED" and one(near, "NUMERIC_TOLERANCE", absolute=0.1)["codes"] == ["CELL_CHANGED"]
    assert one(a.limit(0), "SCHEMA_ONLY")["codes"] == ["MISSING_ROWS"] and one(a.limit(0), "SCHEMA_ONLY", missing=True)["status"] == "PASSED"
    assert one(a.drop("s"), "SCHEMA_ONLY")["codes"] == ["COLUMN_SCHEMA_CHANGED"] and one(a.drop("s"), "MONITOR")["status"] == "INCONCLUSIVE"
    bag = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    sets = lambda x, y: regression.regression(x, y, "SET_EQUIVALENCE", ["v"], missing=True, new=True).first()["status"]
    assert sets(bag(1, 1, 2), bag(1, 2, 2)) == "FAILED" and sets(bag(1, 1, 2), bag(2, 1, 1)) == "PASSED"
    assert one(a, "PRESERVE_AGGREGATE")["codes"] == ["AGGREGATE_QUERY_MUST_RETURN_ONE_ROW"]
    with pytest.raises(ValueError):
        one(a, "EXPECTED_DELTA", least=2.0, most=1.0)


def test_places_are_those_of_a_sort(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("v"), F.lit(1).alias("place"), F.lit(2).alias("at")).repartition(7)
    got = regression.placed(df, ["v"]).select("place", "row.v").collect()
    assert sorted(tuple(r) for r in got) == [(i + 1, i) for i in range(5000)]
    assert regression.placed(df.limit(0), ["v"]).count() == 0


def test_cycles_and_parents(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "a"), ("s", "s"), ("p", "q"), ("q", "p"), ("c", "p")], "from_id string, to_id string")
    assert rows(components.strong_components(e)) == {("a", "a"), ("b", "a"), ("c", "a"), ("s", "s"), ("p", "p"), ("q", "p")}
    assert components.strong_components(e.where("from_id IN ('d', 'x')")).count() == 0
    n = spark.createDataFrame([("v", "w", "VISUAL"), ("w", "p", "GROUP"), ("p", "r", "PAGE"), ("l", "m", "VISUAL"), ("m", "l", "GROUP"), ("o", None, "VISUAL")], "id string, parent_id string, type string")
    assert rows(traversal.path_of_parents(n, n.where("type = 'VISUAL'").select("id"), ["PAGE"])) == {("v", "p")}


def test_a_long_path_is_found(spark):
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", "X") for i in range(35)], "from_id string, to_id string, type string")
    path = traversal.shortest_path(e, "n00", "n35").collect()
    assert len(path) == 36 and path[-1]["id"] == "n35" and traversal.shortest_path(e, "n35", "n00").count() == 0


def test_json_below_six_levels(spark):
    deep = lambda v: '{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":' + v + "}}}}}}}}"
    df = lambda v: spark.createDataFrame([(1, deep(v))], "id int, j string")
    assert rows(align.deep_diff(df("1"), df("2"), "id", "j")) == {(1, "a/b/c/d/e/f/g/h", "changed", "1", "2")}
    two = spark.createDataFrame([(1, '{"a":1,"b":{"c":2,"d":3}}'), (2, '{"b":{"d":3,"c":2},"a":1}'), (3, '{"a":1}')], "id int, j string")
    assert {tuple(r)[1:] for r in comparing.distinct_json(two, "id", "j").collect()} == {(1, 2), (3, 1)}


def test_impact_rules_on_a_small_model(spark):
    o = spark.createDataFrame([
        ("m", "MODEL", "m", None, None), ("t", "TABLE", "m", None, None), ("u", "TABLE", "m", None, None), ("far", "TABLE", "m", None, None), ("c", "COLUMN", "m", "t", None), ("d", "COLUMN", "m", "u", None), ("f", "COLUMN", "m", "far", None),
        ("x", "MEASURE", "m", "u", ["ALL"]), ("y", "MEASURE", "m", "far", ["SUM"]), ("v", "VISUAL", "m", "p", None), ("p", "PAGE", "m", None, None),
    ], "id string, type string, model_id string, parent_id string, behaviors array<string>")
    o = o.withColumns({"name": F.col("id"), "report_id": F.lit(None).cast("string"), "from_column_id": F.lit(None).cast("string"), "to_column_id": F.lit(None).cast("string")})
    rel = spark.createDataFrame([("r", "RELATIONSHIP", "m", "c", "d")], "id string, type string, model_id string, from_column_id string, to_column_id string")
    o = o.unionByName(rel.withColumns({"name": F.lit("r"), "report_id": F.lit(None).cast("string"), "parent_id": F.lit(None).cast("string"), "behaviors": F.lit(None).cast("array<string>")}))
    e = spark.createDataFrame([("USES", "v", "x", "FACT"), ("CONTAINS", "p", "v", "FACT"), ("REFERENCES", "y", "f", "FACT"), ("REFERENCES", "x", "d", "FACT")], "type string, from_id string, to_id string, evidence_class string")
    got = {(r["object_id"], r["rule"]) for r in analysis.impact(o, e, ["r"]).collect()}
    assert {("r", "seed"), ("c", "relationship_endpoint"), ("d", "relationship_endpoint"), ("t", "filter_influence"), ("u", "filter_influence"), ("x", "calculation_context"), ("x", "dax_override:ALL"), ("v", "consumer_closure"), ("p", "report_ancestry")} <= got
    assert not any(i in ("far", "y", "f") for i, _ in got)
    moved = spark.createDataFrame([("r", "to_column_id", "f")], "object_id string, property string, new_value string")
    after = {(r["object_id"], r["rule"]) for r in analysis.impact(o, e, ["r"], moved).collect()}
    assert {("f", "relationship_endpoint"), ("far", "filter_influence"), ("y", "calculation_context")} <= after
    assert {r["object_id"] for r in analysis.impact(o, e, ["r"], with_reports=False).collect()}.isdisjoint({"v", "p"})


def test_formula_calls_and_literals(spark):
    one = lambda text, c: spark.createDataFrame([(text,)], "f string").select(c(F.col("f")).alias("x")).first()["x"]
    calls = {tuple(r)[1:] for r in one("CALCULATE([A], FILTER('My T', T[x] = \"T[q]\"), {1, 2}) // T[z]", expressions.call_references)}
    assert calls == {("CALCULATE", 0, "[A]"), ("CALCULATE", 1, "'My T'"), ("FILTER", 0, "'My T'"), ("CALCULATE", 1, "T[x]"), ("FILTER", 1, "T[x]"), ("CALCULATE", 2, "1"), ("CALCULATE", 2, "2")}
    assert one(")) , [a] (", expressions.call_references) == [] and one("", expressions.call_references) == []
    table = one('DATATABLE("a", STRING, "b", DATETIME, {{"x,{1}", DATE(2020, 1, 2)}, {BLANK(), -1}})', expressions.literal_table)
    assert (list(table["columns"]), table["rows"]) == (["a", "b"], 2)
    assert one('DATATABLE("a", STRING, "A", STRING, {})', expressions.literal_table)["rows"] == 0
    assert one('DATATABLE("a", STRING, "a", STRING, {{"x", "y"}})', expressions.literal_table) is None
    assert [tuple(r) for r in one("'It''s'[a]]b] + [c] + T [d]", expressions.references)] == [("It's", "a]b"), (None, "c"), (None, "d")]


def test_names_of_other_scripts(spark):
    df = spark.createDataFrame([("Ünï Köd",), ("Продажи",), ("数据",), ("--",)], "n string")
    assert [r[0] for r in df.select(keys.alnum_key(F.col("n"))).collect()] == ["ünïköd", "продажи", "数据", ""]
    nodes = df.select(F.monotonically_increasing_id().cast("string").alias("id"), F.lit("T").alias("type"), F.col("n").alias("name"))
    assert [r["name"] for r in search.ranked(nodes, "продажи").collect()] == ["Продажи"]
    texts = spark.createDataFrame([(1, "Die Ünï Köd und Продажи, x " * 3), (2, "x " * 30_000)], "id int, t string")
    assert rows(search.mentions(texts, df.withColumnRenamed("n", "name"), "id", "t").select("id", F.array_join("names", "|"))) == {(1, "ünï köd|продажи")}


def test_denials_and_low_evidence(spark):
    text = spark.createDataFrame([("This is not a selector",), ("not one two three four five six selector",), ("cannot be a selector",), ("doesn't (ever) select a selected value",), (None,), ("",)], "t string")
    assert [r[0] for r in text.select(inference.denies(F.col("t"), ["selector", "selected value"])).collect()] == [True, False, False, True, False, False]
    low = lambda name, value, source, ev, score, kind="x": spark.range(1).select(inference.low_evidence(F.lit(name), F.lit(value), F.lit(source), F.array(*map(F.lit, ev)).cast("array<string>"), F.lit(score), F.lit(kind))).first()[0]
    assert low("[Net Sales]", "net_sales", "description", ["description"], 0.9) and low("a", "b", "dax", ["name", "object_name"], 0.9) and low("a", "b", "name", [], 0.9)
    assert low("a", "b", "dax", [], 0.35) and low("a", "b", "dax", [], 35.0) and not low("a", "b", "dax", [], 0.36) and not low("a", "b", "dax", ["description"], 0.1)
    assert not low("a", "a", "name", [], 0.1, "conflict") and not low("", "", "dax", ["description"], 0.9)


def test_plan_order_with_a_cycle_and_gates(spark):
    ops = spark.createDataFrame([("d1", "model", "DELETE", "column", "c"), ("d2", "model", "DELETE", "measure", "m"), ("n1", "model", "CREATE", "measure", "b"), ("n2", "model", "CREATE", "column", "a"), ("n3", "model", "CREATE", "measure", "z"), ("n4", "model", "CREATE", "measure", "y"), ("r1", "report", "DELETE_VISUAL", "visual", "v")], "operation_id string, domain string, op string, object_type string, object_id string")
    needs = spark.createDataFrame([("d2", "d1"), ("n1", "n2"), ("n3", "n4"), ("n4", "n3")], "operation_id string, needed string")
    got = [tuple(r)[1:] for r in planning.ordered(ops, needs).orderBy("place").select("place", "operation_id", "cyclic").collect()]
    assert got == [("d2", False), ("d1", False), ("n2", False), ("n1", False), ("n4", True), ("n3", True), ("r1", False)]
    clash = planning.name_clashes(spark.createDataFrame([(1, "A", "s"), (2, "b", "s"), (3, "c", "s")], "id int, name string, space string"), spark.createDataFrame([(3,)], "id int"), spark.createDataFrame([(1, "B")], "id int, new_name string"), spark.createDataFrame([(9, "C", "s")], "id int, name string, space string"), ["space"])
    assert rows(clash) == {(1, "B", 1)}


def test_needs_and_breaks(spark):
    head = "id string, type string, name string, model_id string, parent_id string, expression string"
    before = spark.createDataFrame([("t", "TABLE", "Sales", "m", None, None), ("c", "COLUMN", "Qty", "m", "t", None), ("x", "MEASURE", "X", "m", "t", "1"), ("y", "MEASURE", "Y", "m", "t", "[X]")], head)
    after = spark.createDataFrame([("t", "TABLE", "Sales", "m", None, None), ("x", "MEASURE", "New", "m", "t", "1"), ("y", "MEASURE", "Y", "m", "t", "[x] + Sales[qty] + Other[a] + sales[NEW]")], head)
    changes = safety.object_changes(before, after, ["name", "expression"])
    assert {(r["object_id"], r["change"]) for r in changes.collect()} == {("c", "deleted"), ("x", "renamed"), ("y", "changed")}
    links = spark.createDataFrame([("DEPENDS_ON", "y", "x"), ("REFERENCES", "y", "c")], "type string, from_id string, to_id string")
    assert rows(safety.find_breaks(links, links.limit(0), after, changes)) == {("y", "c", "uses_deleted"), ("y", "x", "uses_old_name")}
    assert rows(safety.find_needs(after, changes)) == {("y", "measure_or_column", None, "x"), ("y", "column", "Sales", "qty"), ("y", "table", "Other", None)}


def test_naming_rules_need_enough_objects(spark):
    names = lambda n, good: spark.createDataFrame([(i, "measure", f"net_{i}a" if i < good else f"Odd {i}b", "F") for i in range(n)], "id int, object_type string, name string, folder string")
    found = {(r["check"], r["value"]) for r in profiles.naming_rules(names(100, 80)).collect()}
    assert ("separator", "underscore") in found and ("prefix", "net_") in found and ("folder", "F") in found
    assert {r["check"] for r in profiles.naming_rules(names(100, 79)).collect()} == {"folder"} and profiles.naming_rules(names(4, 4)).count() == 0


def test_smallest_of_a_hub(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.format_string("%04d", "id").alias("v"))
    assert list(validation.smallest(df, "k", "v", 3).first()["items"]) == ["0000", "0001", "0002"]


def test_shared_expressions_need_their_model(spark):
    texts = spark.createDataFrame([("q", "m", 'let x = #"My Path" & "Server" & Server in x'), ("s", "m", "Server")], "id string, model_id string, text string")
    shared = spark.createDataFrame([("s", "m", "Server"), ("p", "m", "My Path"), ("o", "n", "Server")], "id string, model_id string, name string")
    assert rows(formulas.shared_links(texts, shared)) == {("q", "s"), ("q", "p")}


def test_shortest_cycles(spark):
    ring = [(f"n{i}", f"n{(i + 1) % 6}") for i in range(6)]
    more = [("n2", "n4"), ("n5", "t"), ("s", "s"), ("s", "s"), ("a", "b"), ("b", "a"), ("b", "n0"), ("u", "a")]
    e = spark.createDataFrame(ring + more, "from_id string, to_id string")
    groups = components.strong_components(e)
    assert rows(groups) == {(f"n{i}", "n0") for i in range(6)} | {("s", "s"), ("a", "a"), ("b", "a")}
    found = {}
    for cycle, place, node in sorted(tuple(r) for r in components.shortest_cycles(e, groups).select("cycle", "place", "id").collect()):
        found.setdefault(cycle, []).append(node)
    assert found == {"n0": ["n0", "n1", "n2", "n4", "n5", "n0"], "s": ["s", "s"], "a": ["a", "b", "a"]}
    assert components.shortest_cycles(e, groups.limit(0)).count() == 0 and components.strong_components(e.limit(0)).count() == 0


def test_components_joined_by_one_way_links_and_null_ends(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "m"), ("m", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("e", "f"), ("f", "e"), (None, "a"), ("a", None)], "from_id string, to_id string")
    assert rows(components.strong_components(e)) == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e"), ("f", "e")}


def test_deep_chains_of_parents(spark):
    n = spark.range(200).select(F.concat(F.lit("o"), F.col("id")).alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("o"), F.col("id") - 1)).alias("parent_id"), F.when(F.col("id") == 0, "REPORT").otherwise("GROUP").alias("type"), F.lit(1).alias("rank"), F.lit("N").alias("name"))
    loop = spark.createDataFrame([("x", "y", "GROUP", 1, "N"), ("y", "x", "GROUP", 1, "N"), ("z", "x", "GROUP", 1, "N"), ("w", "gone", "GROUP", 2, "W")], "id string, parent_id string, type string, rank int, name string")
    every = n.unionByName(loop)
    assert rows(traversal.path_of_parents(every, every.select("id"), ["REPORT"])) == {(f"o{i}", "o0") for i in range(200)}
    paths = {r["id"]: r["path"] for r in comparing.preorder(every.select("id", "parent_id", "rank", "name")).collect()}
    assert set(paths) == {f"o{i}" for i in range(200)} | {"w"} and paths["w"] == ["02:w:w"]
    assert paths["o199"] == [f"01:n:o{i}" for i in range(200)]


@pytest.mark.parametrize(("x", "y", "absolute", "relative", "passed"), [
    (1.0, 1.1, "0.1", 0, True), (1.1, 1.0, 0.1, 0, True), (1.0, 1.1000000000001, 0.1, 0, False), (10.0, 11.0, 0, "0.0909", False), (10.0, 9.0, 0, 0.1, True), (1e300, 1.1e300, 0, 0.2, True), (1e-20, 2e-20, 1e-20, 0, True), (None, None, 0, 0, True), (None, 1.0, 9, 9, False),
])
def test_tolerance_is_decimal(spark, x, y, absolute, relative, passed):
    a, b = (spark.createDataFrame([(1, v)], "k int, v double") for v in (x, y))
    got = regression.regression(a, b, "NUMERIC_TOLERANCE", ["k"], absolute=float(absolute), relative=float(relative)).first()
    assert got["status"] == ("PASSED" if passed else "FAILED")


def test_tolerance_of_long_decimals(spark):
    from decimal import Decimal

    a, b = (spark.createDataFrame([(1, Decimal(v))], "k int, v decimal(38,21)") for v in ("0.123456789012345678901", "0.123456789012345678902"))
    told = lambda mode, **kw: regression.regression(a, b, mode, ["k"], **kw).first()["status"]
    assert told("EXACT") == "FAILED" and told("NUMERIC_TOLERANCE", absolute=1e-20) == "PASSED" and told("NUMERIC_TOLERANCE", absolute=1e-22) == "FAILED"
    assert told("EXPECTED_DELTA", least=0.0, most=1e-20) == "PASSED"


def test_ties_of_weights_and_roles_of_slicers(spark):
    from weftgraph.operators.inference import evidence_weight
    from weftgraph.sources.folders import use_of

    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(evidence_weight(F.lit("description_object_name"))) == 0.96
    assert [one(use_of(F.lit(r), F.lit("slicer"))) for r in ("Values", "Field", "Y", "Data", "Indicator", "x", "--", "My Role")] == ["slicer_field", "slicer_field", "value", "value", "value", "value", "field", "my_role"]
    assert one(use_of(F.lit("Values"), F.lit("table"))) == "value"


def test_what_an_impact_cannot_see(spark):
    objects = spark.createDataFrame([("c1", "COLUMN", "m", "t1"), ("c2", "COLUMN", "m", "t2"), ("c3", "COLUMN", "m", "gone"), ("c4", "COLUMN", "m", None), ("t1", "TABLE", "m", None), ("t2", "TABLE", "m", None), ("s", "DATA_SOURCE", None, None), ("r", "REPORT", None, None), ("x", "MEASURE", "other", None)],
                                    "id string, type string, model_id string, parent_id string")
    relations = spark.createDataFrame([("ok", "c1", "c2"), ("self", "c1", "c1"), ("no table", "c1", "c3"), ("null table", "c4", "c2"), ("no column", "c1", "t2"), ("null end", "c1", None)], "id string, from_column_id string, to_column_id string")
    findings = spark.createDataFrame([("c1", "diagnostics"), ("c1", "diagnostics"), ("r", "unresolved_fields"), ("x", "diagnostics"), ("c1", "other")], "object_id string, finding string")
    queries = spark.createDataFrame([("q1",), ("q2",)], "id string")
    of = lambda *ids: analysis.unread(objects, ["m"], spark.createDataFrame([(i,) for i in ids], "id string"), relations, findings, queries)
    crooked = {("MISSING_ENDPOINT_TABLE", "no table"), ("MISSING_ENDPOINT_TABLE", "null table"), ("UNRESOLVED_RELATIONSHIP", "no column"), ("UNRESOLVED_RELATIONSHIP", "null end"), ("DIAGNOSTICS", "c1"), ("UNRESOLVED_FIELDS", "r")}
    assert rows(of("c1")) == crooked and rows(of("s")) == crooked | {("UNREAD_M_QUERY", "q1"), ("UNREAD_M_QUERY", "q2")}
    assert rows(analysis.completeness(of("c1").limit(0))) == {("COMPLETE", None, 0)} and rows(analysis.completeness(of("c1").limit(0), False)) == {("INCOMPLETE", None, 0)}
    assert rows(analysis.completeness(of("c1").where("reason = 'DIAGNOSTICS'"))) == {("INCOMPLETE", "DIAGNOSTICS", 1)}
