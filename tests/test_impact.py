"""Golden cases of the impact operators."""

from pyspark.sql import functions as F

from weftgraph.operators import impact
from weftgraph.operators.impact import Rule

EDGE = "from_id string, to_id string, type string"


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def test_closure_keeps_one_shortest_path_and_its_certainty(spark):
    edges = spark.createDataFrame([("b", "a", "USES"), ("c", "a", "USES"), ("d", "b", "USES"), ("d", "c", "GUESS"), ("a", "d", "USES"), ("e", "c", "GUESS"), (None, "a", "USES")], EDGE)
    links = impact.steps(edges, [Rule("uses", ("USES",)), Rule("guess", ("GUESS",), category="POTENTIAL_BEHAVIORAL")])
    got = {r["id"]: (r["depth"], r["rule"], r["category"], r["certainty"], ">".join(r["path"])) for r in impact.closure(links, ids(spark, "a", "a", None), 5).collect()}
    assert got == {
        "a": (0, "seed", "DIRECT", "FACT", "a"),
        "b": (1, "uses", "STRUCTURAL", "FACT", "a>b"),
        "c": (1, "uses", "STRUCTURAL", "FACT", "a>c"),
        "d": (2, "uses", "STRUCTURAL", "FACT", "a>b>d"),
        "e": (2, "guess", "POTENTIAL_BEHAVIORAL", "INFERRED", "a>c>e"),
    }


def test_closure_of_nothing(spark):
    links = impact.steps(spark.createDataFrame([], EDGE), [Rule("uses", ("USES",))])
    assert [r["id"] for r in impact.closure(links, ids(spark, "z"), 3).collect()] == ["z"]


def test_an_inferred_step_makes_the_path_inferred(spark):
    edges = spark.createDataFrame([("b", "a", "USES", False), ("c", "b", "USES", True)], EDGE + ", sure boolean")
    got = impact.closure(impact.steps(edges, [Rule("uses", ("USES",))], F.col("sure")), ids(spark, "a"), 3)
    assert {r["id"]: r["certainty"] for r in got.collect()} == {"a": "FACT", "b": "INFERRED", "c": "INFERRED"}


def test_slice_keeps_parents_not_siblings(spark):
    edges = spark.createDataFrame([("m", "t", "CONTAINS"), ("t", "x", "CONTAINS"), ("t", "y", "CONTAINS"), ("x", "z", "USES")], EDGE)
    moves = [("target", ("CONTAINS",), False, "parent"), ("parent", ("CONTAINS",), False, "parent"), ("target", ("USES",), True, "listed")]
    got = {tuple(r) for r in impact.context_slice(edges, ids(spark, "x"), moves, 5).collect()}
    assert got == {("x", "target"), ("t", "parent"), ("m", "parent"), ("z", "listed")}


def test_upstream_stops_at_the_first_goal(spark):
    edges = spark.createDataFrame([("q", "s1", "X"), ("s1", "s2", "X"), ("q", "p", "X"), ("p", "s3", "X"), ("o", "s3", "X"), ("p", "q", "X")], EDGE)
    got = {tuple(r) for r in impact.upstream(edges, ids(spark, "q", "o"), ids(spark, "s1", "s2", "s3"), 6).collect()}
    assert got == {("q", "s1", 1, "q"), ("q", "s3", 2, "p"), ("o", "s3", 1, "o")}


def test_removal_and_repoint(spark):
    uses = spark.createDataFrame([("v", 1), ("v", 2), ("w", 1), ("w", 1), ("u", 2)], "owner string, item int")
    gone = spark.createDataFrame([(1,)], "item int")
    assert {tuple(r) for r in impact.removal_preview(uses, gone).collect()} == {("v", 2, 1, "remove_field"), ("w", 1, 1, "remove_owner")}
    items = spark.createDataFrame([(1, "k", "a"), (2, "k", "b"), (3, "j", "a")], "item int, kind string, shape string")
    assert [tuple(r) for r in impact.repoint(items, gone, "kind", "shape").collect()] == [(1, 1, 2, True)]


def test_breaks_and_needs(spark):
    edges = spark.createDataFrame([("a", "x", "USES"), ("b", "x", "USES"), ("a", "y", "USES")], EDGE)
    assert [tuple(r) for r in impact.breaks(edges, ids(spark, "x"), ids(spark, "a")).collect()] == [("x", "a")]
    texts = spark.createDataFrame([(1, "[A] + [B] + [A]"), (2, "[B]"), (3, None)], "id int, t string")
    known = spark.createDataFrame([("[A]",)], "name string")
    assert [tuple(r) for r in impact.needs(texts, F.col("t"), r"\[[^\]]+\]", known).collect()] == [("[B]", 2)]


def test_without_a_bound_walks_end_only_with_their_frontier(spark):
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", "USES") for i in range(9)] + [("n09", "n00", "USES")], "from_id string, to_id string, type string")
    reached = impact.closure(impact.steps(chain, [Rule("uses", ("USES",), out=True)]), ids(spark, "n00"))
    assert {r["id"]: r["depth"] for r in reached.collect()} == {f"n{i:02}": i for i in range(10)}
    assert [tuple(r) for r in impact.upstream(chain, ids(spark, "n00"), ids(spark, "n09")).collect()] == [("n00", "n09", 9, "n08")]
    moves = [("target", ("USES",), True, "target")]
    assert impact.context_slice(chain, ids(spark, "n00"), moves).count() == 10
