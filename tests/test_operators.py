"""Golden cases of the graph, compare and search operators."""

import math

from pyspark.sql import functions as F

from weftgraph.functions.keys import name_style, noisy_or
from weftgraph.operators import compare, search, traversal

EDGE = "from_id string, to_id string, type string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_walk_ends_behind_an_ending_edge(spark):
    edges = spark.createDataFrame([("a", "b", "REFERENCES"), ("b", "c", "USES"), ("c", "d", "REFERENCES")], EDGE)
    seeds = spark.createDataFrame([("a",)], "id string")
    assert rows(traversal.walk(edges, seeds, 5, ("USES",))) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(traversal.walk(edges, seeds, None)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_walk_on_a_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "b", "X"), ("b", "c", "X"), ("c", "a", "X")], EDGE)
    assert rows(traversal.walk(edges, spark.createDataFrame([("b",)], "id string"), None)) == [("a", 2), ("b", 0), ("c", 1)]


def test_shortest_path_ties_and_misses(spark):
    edges = spark.createDataFrame([("a", "c", "X"), ("a", "b", "X"), ("c", "d", "X"), ("b", "d", "X"), ("e", "a", "X")], EDGE)
    assert rows(traversal.shortest_path(edges, "a", "d")) == [(0, "a"), (1, "b"), (2, "d")]
    assert rows(traversal.shortest_path(edges, "a", "e")) == []
    assert rows(traversal.shortest_path(edges, "a", "a")) == [(0, "a")]


def test_layers_leave_the_cycle(spark):
    edges = spark.createDataFrame([("a", "b", "X"), ("b", "c", "X"), ("c", "b", "X"), ("a", "d", "X")], EDGE)
    order, left = traversal.layers(edges, spark.createDataFrame([(x,) for x in "abcd"], "id string"))
    assert rows(order) == [("a", 0), ("d", 1)]
    assert rows(left) == [("b",), ("c",)]


def test_dangling(spark):
    edges = spark.createDataFrame([("a", "zz", "X")], EDGE)
    assert rows(traversal.dangling(edges, spark.createDataFrame([("a",)], "id string")).select("end", "id")) == [("to", "zz")]


def test_noisy_or(spark):
    df = spark.createDataFrame([([0.30, 0.86],), ([1.0, 0.2],), ([],)], "w array<double>")
    assert [r[0] for r in df.select(noisy_or(F.col("w"))).collect()] == [0.902, 1.0, 0.0]


def test_styles(spark):
    names = ["Total Sales", "total_sales", "TOTAL SALES", "total sales", "TotalSales", "totalSales", "?"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(name_style(F.col("n"))).collect()] == ["title", "snake", "upper", "lower", "pascal", "camel", "other"]


def test_classify_tells_null_from_empty(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, ""), (4, "d")], "id int, v string")
    assert rows(compare.classify(old, new, "id", ["v"]).select("id", "status")) == [(1, "UNCHANGED"), (2, "CHANGED"), (3, "DELETED"), (4, "NEW")]


def test_bags(spark):
    bag = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    assert rows(compare.bag_difference(bag(1, 1, 2), bag(2, 1, 1))) == []
    assert rows(compare.bag_difference(bag(1, 1, 2), bag(1, 2, 2))) == [(1, 1), (2, -1)]


def test_tolerance(spark):
    one = lambda v: spark.createDataFrame([(1, v)], "k int, v double")
    verdict = lambda r: compare.compare_results(one(100.0), one(100.4), ["k"], ["v"], "NUMERIC_TOLERANCE", relative=r).first()["passed"]
    assert verdict(0.005) and not verdict(0.003)


def test_commonality(spark):
    data = [("m", "total", "sum", "a"), ("m", "total", "sum", "b"), ("m", "margin", "x", "a"), ("m", "margin", "y", "b"), ("m", "orders", "n", "a"), ("m", "number", "n", "b"), ("m", "alone", "z", "a")]
    got = compare.commonality(spark.createDataFrame(data, "kind string, name_key string, signature string, source string"))
    assert {r["name_key"]: r["bucket"] for r in got.collect()} == {"total": "identical", "margin": "differs", "orders": "renamed", "number": "renamed", "alone": "unique"}


def test_ladder(spark):
    df = spark.createDataFrame([("net sales",), ("net sales total",), ("all net sales",), ("sales of net",), ("gross",)], "n string")
    assert [r[0] for r in df.select(search.ladder(F.col("n"), "net sales", 920)).collect()] == [920, 860, 830, 800, None]


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "the the cat"), (2, "the dog"), (3, None)], "id int, t string")
    got = {r["id"]: r["score"] for r in search.bm25(docs, ["the", "cat"], "id", "t").collect()}
    assert set(got) == {1, 2} and got[1] > got[2] and all(map(math.isfinite, got.values()))


def test_shortest_path_over_more_than_32_edges(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", "T") for i in range(34)], "from_id string, to_id string, type string")
    assert rows(traversal.shortest_path(edges, "n00", "n34")) == [(i, f"n{i:02}") for i in range(35)]
    assert rows(traversal.shortest_path(edges, "n00", "n03", 2)) == []
