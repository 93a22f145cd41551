"""What larger tables brought to light."""

import pytest

from weftgraph.operators import impact, search, text_index, walks
from weftgraph.sources import projects


def test_mentions_may_overlap(spark):
    names = spark.createDataFrame([("net and",), ("and by",), ("by net",)], "name string")
    docs = spark.createDataFrame([(1, "Net and by net AND by"), (2, "and by"), (3, "net by")], "id long, t string")
    told = lambda **more: {r["id"]: r["names"] for r in search.mentions(docs, names, "id", "t", **more).collect()}
    assert told(overlapping=True) == {1: ["net and", "and by", "by net"], 2: ["and by"]}
    assert told() == {1: ["net and", "by net", "and by"], 2: ["and by"]}


def test_project_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    texts = {"main.pbip": "{}", "A.Report/definition/pages/p1/page.json": '{"name":"ü"}', "A.Report/x/y/z.json": "", "A.Report/.hidden/v.json": "{}", "A.Report/_v.json": "{}", "A.Report/plain.txt": "t", "empty.tmdl": ""}
    projects.write_files(spark.createDataFrame(list(texts.items()), "file string, text string"), f"{tmp_path}/a b")
    monkeypatch.setattr(type(spark.read), "text", lambda *a, **k: pytest.fail("Spark's reader lists every file in the driver"))
    read = projects.project_files(spark, f"file://{tmp_path}/a b")
    shown = {f: t for f, t in texts.items() if f.endswith(("json", "pbip", "tmdl")) and "/." not in f and "/_" not in f}
    assert {r["file"]: (r["folder"], r["text"]) for r in read.collect()} == {f: ("A.Report" if f.startswith("A") else None, t) for f, t in shown.items()}


def test_project_files_of_another_store_are_read_by_spark(spark, tmp_path):
    projects.write_files(spark.createDataFrame([("A.Report/definition/a+b c.json", "{}")], "file string, text string"), f"{tmp_path}/p")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.told.link./in", f"file://{tmp_path}")
    assert [tuple(r) for r in projects.project_files(spark, "viewfs://told/in/p").select("file", "folder", "text").collect()] == [("A.Report/definition/a+b c.json", "A.Report", "{}")]


def test_an_index_shuffles_its_terms_once(spark, tmp_path, monkeypatch):
    plans, writer = [], type(spark.range(1).write)
    dealt = writer.partitionBy
    monkeypatch.setattr(writer, "partitionBy", lambda self, *c: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or dealt(self, *c))
    index = text_index.build(spark.createDataFrame([(1, "b a b"), (2, "a"), (3, ""), (4, None)], "id long, text string"), f"{tmp_path}/i")
    assert [plan.count("Exchange ") for plan in plans] == [1]
    told = text_index.postings(spark, index, ["a", "b"]).selectExpr("at", "inline(entries)").collect()
    assert {tuple(r) for r in told} == {(0, 1, 1, 3), (0, 2, 1, 1), (1, 1, 2, 3)}


def test_upstream_writes_nothing_for_what_no_edge_leads_to(spark, monkeypatch):
    goals = ["s", "s:0", "s:00", "s:7", "s:32768", "s:999999999", "s:1234567890123", "x\n5"]
    edges = [("p", g) for g in goals] + [("q", "s:7"), ("q", "p"), ("o", "q"), ("o", "p"), ("t", "q"), ("s:7", "s"), ("s:7", "s:7"), ("u", "s:7"), ("alone", "t2")]
    ids = lambda *of: spark.createDataFrame([(i,) for i in of], "id string")
    kept, add = [], impact.Rounds.add
    monkeypatch.setattr(impact.Rounds, "add", lambda self, df: kept.append(df.select("id").distinct()) or add(self, df))
    told = impact.upstream(spark.createDataFrame(edges, "from_id string, to_id string"), ids("o", "t", "u", "q", "s:7", "alone"), ids(*goals))
    from_p = {(g, 2, "p") for g in goals}
    expected = {("o", *x) for x in from_p} | {("q", *x) for x in from_p if x[0] != "s:7"} | {("q", "s:7", 1, "q"), ("t", "s:7", 2, "q"), ("u", "s:7", 1, "u"), ("s:7", "s", 1, "s:7")}
    expected |= {("t", g, 3, "p") for g in goals if g != "s:7"}
    assert {tuple(r) for r in told.collect()} == expected
    assert {r["id"] for df in kept for r in df.collect()} == {"p", "q", "s:7", "t"} - {"t"}


def test_walks_write_no_rows_of_ends(spark, monkeypatch):
    links = [("", "a", "b"), ("", "b", "c"), ("", "a", "x"), ("", "b", "x"), ("", "c", "a"), ("", "c", "y"), ("", "c", "y"), ("s", "a", "z"), ("", None, "y")]
    seeds = [("o", "", "a"), ("o", "", "y"), ("p", "", "c"), ("q", "s", "a"), ("r", "", "x")]
    kept, add = [], walks.Rounds.add
    monkeypatch.setattr(walks.Rounds, "add", lambda self, df: kept.append(add(self, df)) or kept[-1])
    found = walks.reach(spark.createDataFrame(links, "side string, at string, id string"), spark.createDataFrame(seeds, "origin string, side string, id string"))
    told = {(r["origin"], r["id"], r["depth"], ">".join(r["path"]), r["again"]) for r in found.collect()}
    assert told == {
        ("o", "a", 0, "a", False), ("o", "y", 0, "y", False), ("o", "b", 1, "a>b", False), ("o", "x", 1, "a>x", False), ("o", "c", 2, "a>b>c", False), ("o", "a", 3, "a>b>c>a", True), ("o", "y", 3, "a>b>c>y", True),
        ("p", "c", 0, "c", False), ("p", "a", 1, "c>a", False), ("p", "y", 1, "c>y", False), ("p", "b", 2, "c>a>b", False), ("p", "x", 2, "c>a>x", False), ("p", "c", 3, "c>a>b>c", True),
        ("q", "a", 0, "a", False), ("q", "z", 1, "a>z", False), ("r", "x", 0, "x", False),
    }
    assert {r["id"] for df in kept for r in df.collect()} == {"a", "b", "c"}
