"""Golden cases of the merge operators, text folders and replaced tables."""

import json

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.expressions import tokens
from weftgraph.operators import align, merge
from weftgraph.sources import folders

OBJECT = "source string, id string, kind string, tag string, table string, name string"
RENAME = "scope string, table string, name string, new_table string, new_name string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_align_many(spark):
    data = [
        ("a", "t", "TABLE", "g1", None, "Sales"), ("a", "q", "COLUMN", None, "Sales", "Qty"), ("a", "d1", "MEASURE", "dup", "Sales", "M1"),
        ("b", "t", "TABLE", "g1", None, "Orders"), ("b", "q", "COLUMN", None, "Orders", "qty"), ("b", "n", "COLUMN", None, "Orders", "New"), ("b", "d1", "MEASURE", "dup", "Sales", "X1"), ("b", "d2", "MEASURE", "dup", "Sales", "X2"),
        ("c", "n", "COLUMN", None, "Sales", "new"), ("c", "z", "ROLE", None, None, None),
    ]
    got = {(r["row_key"], r["source"], r["id"], r["step"]) for r in merge.align_many(spark.createDataFrame(data, OBJECT), ["a", "b", "c"]).collect()}
    assert {("a:t", "b", "t", "tag"), ("a:q", "b", "q", "key"), ("b:n", "b", "n", None), ("b:n", "c", "n", "key"), ("c:z", "c", "z", None), ("b:d1", "b", "d1", None), ("b:d2", "b", "d2", None)} <= got
    assert len(got) == len(data)
    assert merge.align_many(spark.createDataFrame([], OBJECT), ["a", "b"]).count() == 0


def test_rows_and_marks(spark):
    cells = spark.createDataFrame([("r", "a", "same"), ("r", "b", "moved"), ("s", "b", "same"), ("s", "c", "different"), ("u", "a", "type_conflict")], "row_key string, source string, state string")
    assert rows(merge.compare_rows(cells, "a", 3)) == [("r", "missing", 2, False), ("s", "missing", 2, True), ("u", "type_conflict", 1, False)]
    assert rows(merge.compare_rows(cells.where("row_key = 'r'"), "a", 2)) == [("r", "moved", 2, False)]
    placed = spark.createDataFrame([("a", "1", "r")], "source string, id string, row_key string")
    assert rows(merge.marked(placed, spark.createDataFrame([("a", "1", "x"), ("a", "2", "y")], "source string, id string, mark string"))) == [("a", "1", "x", "r"), ("a", "2", "y", None)]


def test_offers(spark):
    fields = spark.createDataFrame([("d", "p", "v", "Sales", "NewM"), ("d", "p", "v", "Sales", "Qty"), ("d", "p", "v", "Sales", "Gone"), ("d", "p", "w", "Sales", "Qty")], "source string, page string, visual string, entity string, property string")
    one = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert rows(merge.offers(fields, one("sales/newm"), one("QTY"))) == [("d", "page", "p", None, ["Sales[NewM]"], []), ("d", "visual", "v", "p", ["Sales[NewM]"], ["Sales[Gone]"])]
    assert merge.offers(fields, one(), one("QTY")).count() == 0


def test_settle_needs(spark):
    pair = lambda data, other: spark.createDataFrame(data, f"item string, {other} string")
    needs = spark.createDataFrame([("s", i) for i in "abcdefg"], "step string, item string")
    got = merge.settle_needs(needs, pair([("a", "A"), ("b", "B")], "name"), needs.where("item = 'b'").select("item"), pair([("c", "a"), ("d", "zz")], "target"), pair([("d", "D"), ("e", "a"), ("f", None)], "name"))
    assert {(r["item"], r["outcome"], r["target"]) for r in got.collect()} == {("a", "exists", "a"), ("b", "blocked", None), ("c", "mapped", "a"), ("d", "add", "d"), ("e", "clash", None), ("f", "add", "f"), ("g", "missing", None)}


@pytest.mark.parametrize(("name", "parts"), [("salesAmountYTD", ["sales", "Amount", "YTD"]), ("YTDSales2024", ["YTD", "Sales", "2024"]), ("net_sales-total", ["net", "sales", "total"]), ("Margin%", ["Margin", "%"]), ("__", []), ("", [])])
def test_words(spark, name, parts):
    assert spark.range(1).select(merge.words(F.lit(name))).first()[0] == parts


def test_propose_names(spark):
    objects = spark.createDataFrame([(1, "net sales", "t"), (2, "NetSales", "t"), (3, "m_net sales", "u"), (4, "--", "t"), (5, None, "t")], "id int, name string, space string")
    taken = spark.createDataFrame([("M_netsales", "u"), ("m_NetSales (4)", "u")], "name string, space string")
    assert rows(merge.propose_names(objects, taken, ["space"], "pascal", prefix="m_")) == [(1, "net sales", "m_NetSales", False), (2, "NetSales", "m_NetSales (2)", True), (3, "m_net sales", "m_NetSales (5)", True), (4, "--", "--", False), (5, None, None, False)]


def test_rewrite(spark):
    text = "// Sales[Qty]\nVAR x = \"[Old]\" RETURN SUM ( sales[QTY] ) + 'My ''T'''[A]]b] + [old] + Sales[Other] /* [Old] */"
    renames = spark.createDataFrame([("m", "Sales", None, "Orders", None), ("m", "Sales", "Qty", "Orders", "Net Qty"), ("m", None, "Old", None, "N]w"), ("m", "my 't'", "a]b", "It's", None)], RENAME)
    formulas = spark.createDataFrame([("f", "m", text), ("g", "other", text), ("h", "m", None), ("i", None, text), ("j", "m", "")], "id string, scope string, formula string")
    got = {r["id"]: (r["new_formula"], r["changed"]) for r in merge.rewrite(formulas, renames).collect()}
    assert got["f"] == ("// Sales[Qty]\nVAR x = \"[Old]\" RETURN SUM ( Orders[Net Qty] ) + 'It''s'[A]]b] + [N]]w] + Orders[Other] /* [Old] */", 4)
    assert got["g"] == got["i"] == (text, 0) and got["h"] == (None, 0) and got["j"] == ("", 0)
    assert "".join(spark.range(1).select(tokens(F.lit(text))).first()[0]) == text


def test_expected_results(spark):
    a, b = (spark.createDataFrame([(1, v)], "k int, v double") for v in (1.0, 2.0))
    one = lambda mode, **kw: align.verdict(a, b, mode, ["k"], ["v"], **kw).first()["passed"]
    assert one("EXPECTED_VALUE", expected=b) and not one("EXPECTED_CHANGE", expected=a) and not one("EXPECTED_VALUE")
    assert one("EXPECTED_CHANGE", expected=b.withColumn("v", F.lit(2.1)), how="NUMERIC_TOLERANCE", absolute=0.2) and not align.verdict(a, b.union(b), "EXPECTED_VALUE", ["k"], ["v"], expected=b.union(b), how="SET_EQUIVALENCE").first()["passed"]
    with pytest.raises(ValueError, match="MONITOR"):
        one("EXPECTED_VALUE", expected=b, how="MONITOR")


def test_visual_bindings_edges(spark):
    config = json.dumps({"singleVisual": {"visualType": "x", "prototypeQuery": {"From": None, "Select": [{"Measure": {"Expression": {"SourceRef": {"Source": "s"}}, "Property": "M"}, "Name": "n"}, {"Name": "empty"}]}}})
    got = folders.visual_bindings(spark.createDataFrame([(1, config), (2, None), (3, "no json"), (4, "{}")], "id int, config string"))
    assert rows(got) == [(1, "MEASURE", None, "M", None, None)]


def test_visual_levels_and_sort(spark):
    at = lambda s: {"SourceRef": {"Source": s}}
    query = {"From": [{"Name": "d", "Entity": "Date"}], "Select": [{"HierarchyLevel": {"Expression": {"Hierarchy": {"Expression": at("d"), "Hierarchy": "Calendar"}}, "Level": "Year"}, "Name": "l"}],
             "OrderBy": [{"Direction": 2, "Expression": {"Aggregation": {"Expression": {"Column": {"Expression": at("d"), "Property": "Day"}}, "Function": 4}}}]}
    config = json.dumps({"singleVisual": {"visualType": "x", "projections": {"Rows": [{"queryRef": "l"}]}, "prototypeQuery": query}})
    assert rows(folders.visual_bindings(spark.createDataFrame([(1, config)], "id int, config string"))) == [(1, "COLUMN", "Date", "Day", "Max", "sort"), (1, "LEVEL", "Date", "Calendar.Year", None, "rows")]


TEXT = """/// All sales
/// by day
table Sales
\tlineageTag: abc

\t/// Money
\tmeasure 'Total ''net''' =
\t\t\tVAR x = 1
\t\t\t\tcolumn y
\t\t\tRETURN x
\t\tformatString: 0.0
\t\tisHidden

\tcolumn Qty
\t\tdataType: int64

\thierarchy Date
\t\tlevel Year
\t\t\tcolumn: Year

relationship r1
\tfromColumn: Sales.Qty
"""


def test_text_folder(spark, tmp_path):
    (tmp_path / "tables").mkdir()
    (tmp_path / "tables" / "a.tmdl").write_text(TEXT)
    (tmp_path / "b.tmdl").write_text("expression E = 1 + 1\ntable sales\nref table Sales\n")
    (tmp_path / "empty.tmdl").write_text("")
    objects = folders.read_text_folder(spark, str(tmp_path))
    got = {(r["kind"], r["name"]): r for r in objects.collect()}
    assert set(got) == {("table", "Sales"), ("measure", "Total 'net'"), ("column", "Qty"), ("hierarchy", "Date"), ("level", "Year"), ("relationship", "r1"), ("expression", "E"), ("table", "sales")}
    total = got["measure", "Total 'net'"]
    assert (total["parent"], total["description"]) == ("Sales", "Money") and total["text"] == "VAR x = 1\n\tcolumn y\nRETURN x"
    assert [tuple(a) for a in total["attributes"]] == [("formatString", "0.0"), ("isHidden", "true")]
    assert got["table", "Sales"]["description"] == "All sales\nby day" and got["level", "Year"]["parent"] == "Date" and got["expression", "E"]["text"] == "1 + 1"
    assert rows(folders.duplicates(objects)) == [("table", "sales", 2)]


def test_replace_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    folders.replace_table(spark.range(3), path)
    folders.replace_table(spark.range(5), path)
    assert folders.read_table(spark, path).count() == 5
    broken = spark.range(2).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        folders.replace_table(broken, path)
    assert folders.read_table(spark, path).count() == 5
