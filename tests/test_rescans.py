"""Rescans against a full scan."""

import os
import re
from collections import defaultdict

from weftgraph.streaming import rescans
from weftgraph.streaming.rescans import State, rescan

RECORD = "id string, name string, formula string, deleted boolean"


def full(objects):
    """Edges of all objects, from nothing."""
    by_name = defaultdict(list)
    for i, (name, _) in objects.items():
        if name is not None:
            by_name[name.lower()].append(i)
    return {(i, n.lower(), min(by_name[n.lower()])) for i, (_, formula) in objects.items() for n in re.findall(rescans.REFERENCE, formula or "") if by_name[n.lower()]}


def check(state, objects):
    assert {tuple(r) for r in state.now("edges").collect()} == full(objects)
    assert {(r["id"], r["name"]) for r in state.now("objects").collect()} == {(i, n and n.lower()) for i, (n, _) in objects.items()}
    assert sorted((r["name"], r["id"]) for r in state.now("names").collect()) == sorted((n.lower(), i) for i, (n, _) in objects.items() if n is not None)
    assert {(r["name"], r["from_id"]) for r in state.now("references").collect()} == {(n.lower(), i) for i, (_, f) in objects.items() for n in re.findall(rescans.REFERENCE, f or "")}


def test_each_batch_gives_what_a_full_scan_would(spark, tmp_path):
    state, objects = State(spark, str(tmp_path / "s"), 8), {}
    start = {f"o{i}": (f"N{i}", f"[N{i // 2}] + [n{i + 1}]" if i else None) for i in range(40)} | {"nameless": (None, "[N3]"), "waits": ("Waits", "[Later] * [N5] + [Later]")}
    batches = [
        {i: (*v, False) for i, v in start.items()},
        {"o3": ("Renamed", "[N1] + [n4]", False), "late": ("LATER", None, False), "o7": (None, None, True), "o9": ("N9", "[N4] + [n10]", False), "twin": ("n5", None, False), "never": ("x", "y", True)},
        {"o3": ("N3", "[Later]", False), "late": ("Other", "[Waits]", False), "o5": (None, None, True), "o7": ("N7", "[N7]", False)},
        {"o9": ("N9", "[N4] + [n10]", False)},
    ]
    told = []
    for number, batch in enumerate(batches):
        got = rescan(state, spark.createDataFrame([(i, *v) for i, v in batch.items()], RECORD), number)
        told.append({r["id"]: r["status"] for r in got.collect()})
        for i, (name, formula, deleted) in batch.items():
            objects.pop(i, None)
            if not deleted:
                objects[i] = (name, formula)
        check(state, objects)
    assert set(told[0].values()) == {"NEW"} and told[3] == {"o9": "UNCHANGED"}
    assert {k: told[1][k] for k in ("o3", "late", "o7", "twin", "never")} == {"o3": "CHANGED", "late": "NEW", "o7": "DELETED", "twin": "NEW", "never": "UNCHANGED"} and told[1]["o9"] == "UNCHANGED"
    assert {i for i, s in told[1].items() if s == "INVALIDATED"} >= {"waits", "o2", "o6", "nameless", "o14", "o15"}
    again = rescan(state, spark.createDataFrame([("o3", "N3", "[Later]", False), ("late", "Other", "[Waits]", False), ("o5", None, None, True), ("o7", "N7", "[N7]", False)], RECORD), 2)
    assert {r["id"]: r["status"] for r in again.collect()} == told[2]


def test_a_batch_leaves_other_buckets_alone(spark, tmp_path):
    state = State(spark, str(tmp_path / "s"), 64)
    rescan(state, spark.createDataFrame([(f"o{i}", f"N{i}", f"[N{i - 1}]", False) for i in range(300)], RECORD), 0)
    rescan(state, spark.createDataFrame([("o7", "N7", "[N8]", False)], RECORD), 1)
    wrote = {t: [b for b in os.listdir(tmp_path / "s" / t) if b.startswith("bucket=") and os.path.isdir(tmp_path / "s" / t / b / "batch=1")] for t in rescans.TABLES}
    assert {t: len(b) for t, b in wrote.items()} == {"objects": 1, "names": 2, "references": 2, "edges": 1}
    assert ("o7", "n8", "o8") in {tuple(r) for r in state.now("edges").collect()} and state.now("edges").count() == 299


def test_streams_of_records(spark, tmp_path):
    objects = {}
    for n, rows in enumerate([[("a", "A", "[B]", False), ("c", "C", "[A]", False)], [("b", "B", None, False)], [("a", None, None, True)]]):
        spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        state = State(spark, f"{tmp_path}/s", 4)
        rescans.rescans(spark.readStream.schema(RECORD).parquet(f"{tmp_path}/in"), state, f"{tmp_path}/checkpoint", f"{tmp_path}/out")
        objects |= {i: (name, f) for i, name, f, _ in rows}
        objects = {i: v for i, v in objects.items() if not any(r[0] == i and r[3] for r in rows)}
        check(state, objects)
    assert {(r["batch"], r["id"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(0, "a", "NEW"), (0, "c", "NEW"), (1, "b", "NEW"), (1, "a", "INVALIDATED"), (2, "a", "DELETED"), (2, "c", "INVALIDATED")}
