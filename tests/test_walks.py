"""Plan walks over a target and its donors."""

from weftgraph.operators import walks

OBJECT = "source string, id string, name string"
LINK = "source string, from_id string, to_id string"


def items(df):
    return {(r["cause"], r["source"], r["object_id"], r["severity"], r["certainty"], r["blocking"], ">".join(r["path"])) for r in df.collect()}


def test_needs_run_on_until_closed_and_are_settled_on_the_target(spark):
    target = spark.createDataFrame([("table:Sales", "Sales"), ("column:Sales/Amount", "Amount"), ("column:T/Rate", "Rate")], "id string, name string")
    donors = [("s2", "table:D", "D"), ("s2", "column:D/Col", "DonorCol"), ("s2", "measure:D/M", "DonorM"), ("s2", "measure:D/Top", "Top"), ("s2", "column:D/Amt", "amt"), ("s2", "column:D/Rate", "RATE"), ("s2", "measure:D/Loop", "Loop"), ("s2", "measure:D/Round", "Round"), ("s3", "measure:D/M", "Other")]
    links = [("s2", "measure:D/M", "column:D/Col"), ("s2", "measure:D/Top", "measure:D/M"), ("s2", "measure:D/M", "column:D/Amt"), ("s2", "column:D/Amt", "column:D/Rate"), ("s2", "measure:D/Top", "column:nowhere"),
             ("s2", "measure:D/Loop", "measure:D/Round"), ("s2", "measure:D/Round", "measure:D/Loop"), ("s3", "measure:D/M", "column:Sales/Amount"), (None, "measure:D/Top", "table:D"), ("s2", None, "table:D")]
    alignment = spark.createDataFrame([("s2", "column:D/Amt", "column:Sales/Amount"), ("s2", "measure:D/M", "measure:gone")], "source string, id string, target_id string")
    adds = spark.createDataFrame([("measure:D/Top", "s2"), ("measure:D/Loop", "s2"), ("measure:D/Loop", "s2"), ("measure:absent", "s2"), ("measure:D/M", "s3")], "row_key string, source string")
    args = (adds, spark.createDataFrame(donors, OBJECT), spark.createDataFrame(links, LINK), target, alignment)
    top, amt = "measure:D/Top>measure:D/M", "measure:D/Top>measure:D/M>column:D/Amt"
    expected = {
        ("measure:D/Top", "s2", "measure:D/M", "will_be_added", "certain", False, top), ("measure:D/Top", "s2", "column:D/Col", "missing", "certain", True, f"{top}>column:D/Col"),
        ("measure:D/Top", "s2", "column:D/Rate", "name_clash", "certain", True, f"{amt}>column:D/Rate"), ("measure:D/Loop", "s2", "measure:D/Round", "missing", "certain", True, "measure:D/Loop>measure:D/Round"),
        ("measure:D/Loop", "s2", "measure:D/Loop", "will_be_added", "certain", False, "measure:D/Loop>measure:D/Round>measure:D/Loop"),
    }
    assert items(walks.needs(*args)) == expected
    said = spark.createDataFrame([("column:D/Col", "map_to_target"), ("column:D/Rate", "add_from_donor"), ("measure:D/Round", "drop_added_object")], "object_id string, action string")
    assert {(i[2], i[3], i[5]) for i in items(walks.needs(*args, said))} == {("measure:D/M", "will_be_added", False), ("column:D/Col", "mapped", False), ("column:D/Rate", "will_be_added", False), ("measure:D/Round", "missing", False), ("measure:D/Loop", "will_be_added", False)}
    assert walks.needs(adds.limit(0), *args[1:]).count() == 0


def test_breaks_are_certain_over_facts_alone(spark):
    target = spark.createDataFrame([(x,) for x in "abcdevw"], "id string")
    links = spark.createDataFrame([("b", "a", True), ("v", "b", True), ("w", "a", False), ("v", "w", True), ("d", "c", True), ("c", "d", True), ("e", "c", False), ("w", "e", True)], "from_id string, to_id string, fact boolean")
    changes = spark.createDataFrame([("r1", "a", "deleted"), ("r2", "c", "renamed"), ("r3", "gone", "deleted"), ("r4", "b", "modified")], "row_key string, object_id string, change string")
    told = items(walks.breaks(changes, target, links))
    assert told == {
        ("r1", None, "b", "breaks", "certain", True, "a>b"), ("r1", None, "v", "breaks", "certain", True, "a>b>v"), ("r1", None, "w", "needs_review", "possible", False, "a>w"),
        ("r2", None, "d", "breaks", "certain", True, "c>d"), ("r2", None, "e", "needs_review", "possible", False, "c>e"),
        ("r2", None, "w", "needs_review", "possible", False, "c>e>w"), ("r2", None, "v", "needs_review", "possible", False, "c>e>w>v"), ("r4", None, "v", "changes_value", "certain", False, "b>v"),
    }
    policies, included = spark.createDataFrame([("r1", "cascade")], "row_key string, policy string"), spark.createDataFrame([("r2", "d")], "row_key string, object_id string")
    assert {(i[0], i[2]) for i in items(walks.breaks(changes, target, links, policies, included)) if i[5]} == set()
    assert {(i[0], i[2]) for i in items(walks.breaks(changes, target, links, policies)) if i[5]} == {("r2", "d")}


def test_siblings_by_id_and_by_last_part(spark):
    changes = spark.createDataFrame([("r", "measure:T/M", "deleted"), ("q", "plain", "deleted"), ("s", "measure:T/R", "renamed")], "row_key string, object_id string, change string")
    fields = spark.createDataFrame([("rep", "v1", "measure:T/M"), ("rep", "v2", "measure:U/M"), ("rep", "v3", "measure:T/R"), ("rep", "v4", "plain"), ("rep", "v4", "plain"), ("rep", "v5", None)], "source string, object_id string, field string")
    assert {(i[0], i[2], i[3]) for i in items(walks.siblings(changes, fields))} == {("measure:T/M", "v1", "not_changed_by_this_plan"), ("measure:U/M", "v2", "not_changed_by_this_plan"), ("plain", "v4", "not_changed_by_this_plan")}
