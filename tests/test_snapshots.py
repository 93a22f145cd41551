"""Golden cases of metadata sources and sinks, alignment, verdicts, search additions and streams."""

import json

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import align, search
from weftgraph.sources import metadata
from weftgraph.streaming import changes

MODEL = {"id": "m", "name": "Model", "tables": [
    {"id": "t", "name": "Sales", "columns": [{"id": "c1", "name": "Qty"}, {"id": "c2", "name": "Key"}], "measures": [{"id": "x", "name": "Total", "expression": "SUM(Sales[Qty])"}]},
    {"id": "u", "name": "Empty", "columns": None}], "relationships": [{"id": "r", "fromColumn": "c2", "toColumn": "c9"}]}
REPORT = {"id": "rep", "name": "Report", "modelId": "m", "sections": [{"id": "p", "displayName": "Page", "visualContainers": [{"id": "v", "title": "V", "fields": [{"objectId": "c1"}, {"objectId": "c1"}, {"objectId": "x"}]}, {"id": "w", "title": None}]}]}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("models")
    (folder / "a.json").write_text(json.dumps([MODEL, {"id": "n", "name": "Bare"}]))
    (folder / "b.json").write_text(json.dumps({"id": "o"}))
    (folder / "report.txt").write_text(json.dumps(REPORT))
    return folder


def test_models_to_graph(spark, files):
    models = metadata.read_models(spark, f"{files}/*.json")
    nodes = metadata.model_nodes(models)
    assert {(r["id"], r["type"], r["parent_id"]) for r in nodes.collect()} == {("m", "MODEL", None), ("n", "MODEL", None), ("o", "MODEL", None), ("t", "TABLE", "m"), ("u", "TABLE", "m"), ("c1", "COLUMN", "t"), ("c2", "COLUMN", "t"), ("x", "MEASURE", "t"), ("r", "RELATIONSHIP", "m")}
    assert metadata.containment(nodes).count() == 6
    assert {tuple(r) for r in metadata.relations(models).collect()} == {("r", "c2", "RELATES_FROM"), ("r", "c9", "RELATES_TO")}


def test_reports_to_graph(spark, files):
    reports = metadata.read_reports(spark, f"{files}/report.txt")
    assert {(r["id"], r["parent_id"]) for r in metadata.report_nodes(reports).collect()} == {("rep", None), ("p", "rep"), ("v", "p"), ("w", "p")}
    assert {tuple(r) for r in metadata.usage(reports).collect()} == {("v", "c1", "USES"), ("v", "x", "USES"), ("rep", "m", "USES_MODEL")}


def test_manifest_and_content_id(spark, files):
    got = {r["path"]: r["size"] for r in metadata.manifest(spark, str(files)).collect()}
    assert got == {n: (files / n).stat().st_size for n in ("a.json", "b.json")}
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    one = lambda df: tuple(metadata.content_id(df).first())
    assert one(a) == one(a.orderBy(F.desc("id")).select("v", "id")) != one(a.union(a.limit(1)))
    assert one(a) != one(a.fillna("")) and one(a.limit(0))[0] == 0


def test_canonical_round_trip_and_cards(spark, tmp_path):
    nodes = spark.createDataFrame([("b", "T", None), ("a", "T", "A")], "id string, type string, name string")
    metadata.write_canonical(nodes, f"{tmp_path}/n")
    back = metadata.read_canonical(spark, f"{tmp_path}/n", nodes.schema.simpleString()[7:-1].replace(":", " "))
    assert sorted(map(str, back.collect())) == sorted(map(str, nodes.collect()))
    metadata.write_cards(metadata.card_lines(nodes, spark.createDataFrame([("a", "b", "USES")], "from_id string, to_id string, type string")), f"{tmp_path}/c", 2)
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/c").collect()) == ["# A (T)", "# b (T)", "in USES a", "out USES b"]


def test_align_and_states(spark):
    head = "id string, kind string, tag string, table string, name string, signature string"
    left = spark.createDataFrame([("1", "M", "x", "t", "Old", "s"), ("2", "M", None, "t", "Sum A", "s2"), ("3", "M", "d", "t", "Gone", "s3"), ("4", "C", None, "t", "Kind", "k"), ("5", "M", "d", "t", "Renamed", "only")], head)
    right = spark.createDataFrame([("a", "M", "x", "t", "New", "s"), ("b", "M", None, "u", "sum_a", "s2"), ("d", "M", None, "t", "kind", "z"), ("e", "M", "d", "t", "Other", "only")], head)
    matches = align.align(left, right)
    assert {tuple(r) for r in matches.collect()} == {("1", "a", "tag"), ("2", "b", "moved"), ("4", "d", "type_conflict"), ("5", "e", "possible_rename")}
    assert {tuple(r) for r in align.cell_states(left, right, matches).collect()} == {("1", "renamed"), ("2", "renamed"), ("3", "missing"), ("4", "type_conflict"), ("5", "renamed")}
    key = align.alignment_key(F.lit("RELATIONSHIP"), F.lit(None), F.lit(None), F.array(F.lit("B[x]"), F.lit("A[y]")))
    assert spark.range(1).select(key).first()[0] == "RELATIONSHIP|ay~bx"


def test_deep_diff(spark):
    old = spark.createDataFrame([(1, '{"a": {"b": 1, "c": [1, 2]}, "e": {}}'), (2, None), (3, "no json")], "id int, j string")
    new = spark.createDataFrame([(1, '{"a": {"b": 2, "c": [1, 3], "d": {"x": null}}, "e": {}}'), (2, '{"z": 1}'), (3, "")], "id int, j string")
    got = {(r["id"], r["path"], r["change"]) for r in align.deep_diff(old, new, "id", "j").collect()}
    assert got == {(1, "a/b", "changed"), (1, "a/c", "changed"), (1, "a/d/x", "added"), (2, "z", "added")}


def test_deep_diff_keeps_types(spark):
    cases = [
        ('{"a":{"b":1},"c":1}', '{"a":"{\\"b\\":1}","c":"1"}', {("a", "changed", '{"b":1}', '"{\\"b\\":1}"'), ("c", "changed", "1", '"1"')}),
        ('{"a":null}', "{}", {("a", "removed", "null", None)}), ('{"a":null}', '{"a":"null"}', {("a", "changed", "null", '"null"')}), ('{"a":true}', '{"a":"true"}', {("a", "changed", "true", '"true"')}),
        ('{"a":{}}', '{"a":{"b":{}}}', {("a/b", "added", None, "{}")}), ('{"a":[]}', '{"a":{}}', {("a", "changed", "[]", "{}")}), ('{"a":{"x":1}}', '{"a":[1]}', {("a", "changed", '{"x":1}', "[1]")}),
        ('{"a/b":{"~":1}}', '{"a/b":{"~":2}}', {("a~1b/~0", "changed", "1", "2")}), ('{"a":1,"b":2}', '{"b":2,"a":1}', set()), ('{"a":1}', '{"a":1.0}', {("a", "changed", "1", "1")}), ('{"a":1.0}', '{"a":1.00}', set()),
    ]
    old, new = (spark.createDataFrame([(i, c[k]) for i, c in enumerate(cases)], "id int, j string") for k in (0, 1))
    got = {}
    for r in align.deep_diff(old, new, "id", "j").collect():
        got.setdefault(r["id"], set()).add((r["path"], r["change"], r["old_value"], r["new_value"]))
    assert got == {i: c[2] for i, c in enumerate(cases) if c[2]}


def test_verdicts(spark):
    t = lambda *v: spark.createDataFrame(list(v), "k int, v double")
    passed = lambda a, b, mode, **kw: align.verdict(a, b, mode, ["k"], ["v"], **kw).first()["passed"]
    assert passed(t((1, 1.0)), t((1, 1.4)), "PRESERVE_AGGREGATE", absolute=0.5) and not passed(t((1, 1.0), (2, 1.0)), t((1, 1.0), (2, 1.0)), "PRESERVE_AGGREGATE")
    assert not passed(t((1, 1.0)), t((2, 1.0)), "EXACT") and passed(t((1, 1.0)), t((1, 1.0), (2, 1.0)), "EXACT", new=True)
    assert passed(t((1, 1.0)), t(), "MONITOR") is None and not passed(t(), spark.createDataFrame([], "k int, w double"), "SCHEMA_ONLY")
    both = align.verdict(t(), t(), "SCHEMA_ONLY", ["k"], ["v"]).union(align.verdict(t(), t(), "MONITOR", ["k"], ["v"]))
    assert tuple(align.roll_up(both).first()) == (1, 0, 1, "INCONCLUSIVE")


def test_search_additions(spark):
    nodes = spark.createDataFrame([("m", "MODEL", "Net Sales", None), ("a", "M", "net sales", "m"), ("b", "M", "Margin", "m"), ("c", "M", None, "z")], "id string, type string, name string, model_id string")
    assert sorted(r["id"] for r in search.scope(nodes, models=["m"]).collect()) == ["a", "b", "m"]
    assert {r["id"]: (r["score"], len(r["evidence"])) for r in search.evidence(nodes, "m").collect()} == {"m": (1000, 1), "b": (860, 1)}
    names = spark.createDataFrame([("net_sales",), ("Net-Sales",), ("margin",), ("a",), ("x",)], "wanted string")
    assert {r["wanted"]: (r["candidates"], r["id"]) for r in search.resolve(nodes, names).collect()} == {"net_sales": (0, None), "Net-Sales": (2, None), "margin": (1, "b"), "a": (1, "a"), "x": (0, None)}


@pytest.mark.parametrize("most", [10_000, 0])
def test_mentions_take_the_longest_first(spark, monkeypatch, most):
    monkeypatch.setattr(search, "MOST_FIRST_WORDS", most)
    names = spark.createDataFrame([("Net Sales",), ("Sales",), ("Sales Margin",), ("of",), (None,)], "name string")
    docs = spark.createDataFrame([(1, "the net sales margin, Net Sales again"), (2, "sales of sales"), (3, None), (4, "Sales, Sales margin of")], "id int, t string")
    assert {r["id"]: list(r["names"]) for r in search.mentions(docs, names, "id", "t").collect()} == {1: ["net sales", "sales"], 4: ["sales", "sales margin"]}


def test_stream_state_goes_over_batches(spark, tmp_path):
    head = "k string, n int, v string"
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), (None, 1, "x")], head).coalesce(1).write.parquet(f"{tmp_path}/in.parquet")
    for rows in ([], [("a", 3, "y"), ("b", 1, None)]):
        if rows:
            spark.createDataFrame(rows, head).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in.parquet")
        changes.drain(changes.classify(changes.read_table(spark, str(tmp_path), "in"), "k", "n", ["v"]), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 1, "NEW"), ("a", 2, "UNCHANGED"), ("a", 3, "CHANGED"), ("b", 1, "NEW")}


def test_stream_classes_do_not_depend_on_batches(spark, tmp_path):
    head = "k string, n int, v string"
    for rows in ([("a", 3, "y"), ("b", 2, "x")], [("a", 1, "x"), ("a", 2, "y"), ("b", 3, "x")], [("b", 1, "z"), ("a", 4, "x")]):
        spark.createDataFrame(rows, head).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in.parquet")
    for files in (1, 1000):
        changes.drain(changes.classify(changes.read_table(spark, str(tmp_path), "in", files), "k", "n", ["v"]), f"{tmp_path}/out{files}", f"{tmp_path}/state{files}")
        got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out{files}").collect()}
        assert got == {("a", 1, "NEW"), ("a", 2, "CHANGED"), ("a", 3, "UNCHANGED"), ("a", 4, "CHANGED"), ("b", 1, "NEW"), ("b", 2, "CHANGED"), ("b", 3, "UNCHANGED")}


def test_set_equivalence_is_strict_whatever_is_allowed(spark):
    a, b = (spark.createDataFrame([(k, 1.0) for k in ks], "k int, v double") for ks in ([1, 1, 2], [1, 2, 3]))
    row = align.verdict(a, b, "SET_EQUIVALENCE", ["k"], ["v"], missing=True, new=True).first()
    assert (row["passed"], row["missing_rows"], row["new_rows"]) == (False, 1, 1)
