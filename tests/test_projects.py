"""Project folders with pointers, reports and declarations."""

import json

import pytest
from pyspark.sql import functions as F

from weftgraph.sources import projects

FILES = {
    "main.pbip": json.dumps({"artifacts": [{"report": {"path": "R one.Report"}}, {"type": "Report", "path": "./sub/../Gone.Report"}, {"semanticModel": {"path": "nowhere.SemanticModel"}}]}),
    "all.pbip": "{}", "bad.pbip": "no json",
    "R one.Report/definition.pbir": json.dumps({"datasetReference": {"byPath": {"path": "../deep/Far.SemanticModel"}}}),
    "R one.Report/definition/pages/p1/page.json": json.dumps({"displayName": "First"}), "R one.Report/definition/pages/p1/visuals/v1/visual.json": json.dumps({"name": "V"}),
    "R one.Report/definition/pages/p1/visuals/v1/mobile.json": "{}", "R one.Report/definition/pages/p2/visuals/v2/mobile.json": "{}", "R one.Report/definition/pages/pages.json": "{}",
    "Two.report/definition.pbir": json.dumps({"datasetReference": {"byPath": {"path": "../../out.SemanticModel"}}}),
    "M.SemanticModel/definition/tables/a.tmdl": "table Sales\n\tcolumn x\ntable 'Odd ''T'''\n/// table Sales\n", "M.SemanticModel/definition/tables/b.tmdl": "table SALES\ntable 'odd ''t'''\nexpression e = 1\n",
    "M.SemanticModel/definition/TMDLScripts/c.tmdl": "expression e = 1\n", "M.SemanticModel/other.tmdl": "expression e = 2\n", "deep/Far.SemanticModel/definition/model.tmdl": "table Sales\n",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("a b"))
    projects.write_files(spark.createDataFrame(list(FILES.items()), "file string, text string").repartition(3), root)
    read = projects.project_files(spark, root).cache()
    assert {r["file"]: r["text"] for r in read.collect()} == FILES
    return read


def test_what_belongs_to_a_project(files):
    got = {tuple(r) for r in projects.artifacts(files).collect()}
    one = ("report", "R one.Report", "deep/Far.SemanticModel")
    beside = {one, ("report", "Two.report", None), ("model", "M.SemanticModel", None), ("model", "deep/Far.SemanticModel", None)}
    assert got == {("main.pbip", *one), ("main.pbip", "model", "deep/Far.SemanticModel", None), ("main.pbip", "model", "M.SemanticModel", None)} | {(p, *b) for p in ("all.pbip", "bad.pbip") for b in beside}


def test_objects_over_several_files(files):
    got = {(r["folder"], r["kind"], r["id"], r["parent"], r["name"], tuple(r["parts"])) for r in projects.report_objects(files).collect()}
    assert got == {("R one.Report", "page", "p1", None, "First", ()), ("R one.Report", "visual", "v1", "p1", "V", ("mobile",))}


def test_repeated_declarations(files):
    got = {(r["folder"], r["kind"], r["name"], tuple(r["files"]), r["places"]) for r in projects.repeated_declarations(files).collect()}
    both = ("definition/tables/a.tmdl", "definition/tables/b.tmdl")
    assert got == {("M.SemanticModel", "table", "Sales", both, 2), ("M.SemanticModel", "table", "Odd 'T'", both, 2)}


def test_paths(spark):
    paths = ["a/../b/./c", "../x", "a//b\\c", "", None, "a/.."]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i").select(projects.clean_path(F.col("p"))).collect()
    assert [r[0] for r in got] == ["b/c", None, "a/b/c", "", None, ""]
