"""A plan compiled end to end."""

from weftgraph.operators import compiling

ROWS = "row_key string, object_type string"
CELLS = "source string, row_key string, name string, table string, formula string"
LINKS = "source string, from_row string, to_row string"
CHOICES = "row_key string, choice string, source_id string, new_name string, properties array<string>, policy string, repoint string"


def compiled(spark, cells, links, choices, said=(), included=()):
    rows = sorted({c[1] for c in cells})
    frame = lambda data, schema: spark.createDataFrame(list(data), schema)
    got = compiling.compile_plan(
        frame([(r, "measure") for r in rows], ROWS), frame(cells, CELLS), frame(links, LINKS), frame([(*c, None, None, None)[:7] if len(c) < 7 else c for c in choices], CHOICES), "t",
        frame(said, "row_key string, action string, target_row string"), frame(included, "row_key string, cause string"),
    ).collect()
    ops = [(r["what"], r["object_id"], r["text"]) for r in sorted((r for r in got if r["kind"] == "operation"), key=lambda r: r["place"])]
    return ops, {(r["kind"], r["what"], r["object_id"], r["cause"]) for r in got if r["kind"] != "operation"}


def test_needs_renames_and_clashes_meet(spark):
    cells = [
        ("t", "base", "Base", None, "1"), ("t", "user", "User", None, "[Base] + 1"), ("t", "other", "Other", None, "[Base] * [User]"), ("t", "old", "Old", None, "2"), ("t", "on old", "On Old", None, "[Old]"), ("t", "taken", "Clash", None, "3"),
        ("d", "base", "Donor Base", None, "9"), ("d", "top", "Top", None, "[Mid] + [Donor Base]"), ("d", "mid", "Mid", None, "[Leaf] + [clash]"), ("d", "leaf", "Leaf", None, "[Mid]"), ("d", "named", "clash", None, "4"),
        ("d", "wide", "Wide", None, "[Old] + [Drop]"), ("d", "old", "Old", None, "5"), ("d", "drop", "Drop", None, "6"), ("d", "user", "User", None, "[Donor Base] + [Top]"), ("e", "far", "Far", None, "[Leaf]"), ("d", "needs far", "Needs Far", None, "[Far]"),
    ]
    links = [
        ("t", "user", "base"), ("t", "other", "base"), ("t", "other", "user"), ("t", "on old", "old"), ("d", "top", "mid"), ("d", "top", "base"), ("d", "mid", "leaf"), ("d", "mid", "named"), ("d", "leaf", "mid"),
        ("d", "wide", "old"), ("d", "wide", "drop"), ("d", "user", "base"), ("d", "user", "top"), ("d", "needs far", "far"), ("e", "far", "leaf"), ("t", "nowhere", "base"),
    ]
    choices = [("top", "take", "d", None), ("base", "edit", None, "Renamed"), ("user", "take", "d", None), ("old", "remove", None, None), ("wide", "take", "d", None), ("needs far", "take", "d", None), ("mid", "shout", None, None), ("leaf", "remove", None, None)]
    ops, told = compiled(spark, cells, links, choices, [("drop", "drop_added_object", None)], [("other", "base")])
    done = {"DELETE": ["old"], "RENAME": ["base"], "CREATE": ["far", "leaf", "mid", "needs far", "top"], "REPLACE": ["user"], "REWRITE_EXPRESSION": ["other"]}
    assert sorted(o[:2] for o in ops) == sorted((op, x) for op, ids in done.items() for x in ids)
    texts = dict(((o[0], o[1]), o[2]) for o in ops)
    assert texts["CREATE", "top"] == "[Mid] + [Renamed]" and texts["REPLACE", "user"] == "[Renamed] + [Top]" and texts["REWRITE_EXPRESSION", "other"] == "[Renamed] * [User]" and texts["RENAME", "base"] == "Renamed"
    assert [o[0] for o in ops] == ["DELETE", "RENAME"] + ["CREATE"] * 5 + ["REPLACE", "REWRITE_EXPRESSION"]
    assert told >= {
        ("blocking", "removal_blocked", "on old", "old"), ("blocking", "unknown_kind", "mid", None), ("blocking", "no_target_object", "leaf", None), ("blocking", "need_clash", "mid", "named"), ("warning", "need_added", "top", "mid"),
        ("warning", "need_added", "mid", "leaf"), ("warning", "need_added", "needs far", "far"), ("blocking", "dependency_cycle", "mid", None), ("blocking", "dependency_cycle", "leaf", None),
    }
    assert not any(t[2] == "wide" for t in told)  # what it needed was said to be dropped, and so was it


def test_a_new_name_and_one_name_from_two_rows(spark):
    cells = [("t", "a", "A", None, "1"), ("d", "a", "A", None, "[X] + [x]"), ("d", "x1", "X", None, "1"), ("d", "x2", "x", None, "2")]
    ops, told = compiled(spark, cells, [("d", "a", "x1"), ("d", "a", "x2")], [("a", "add_new_name", "d", "B")])
    assert [o[:2] for o in ops] == [("CREATE", "x1"), ("CREATE", "a#new")]
    assert told == {("warning", "need_added", "a#new", "x1"), ("blocking", "need_clash", "a#new", "x2")}
