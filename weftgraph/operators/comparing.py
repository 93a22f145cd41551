"""Compare rows filtered and sorted, properties compared by their kind, snapshots and pending changes held against each other."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.expressions import formula_key, plain_text, reference_name, reference_table, tokens
from weftgraph.operators.align import leaves
from weftgraph.functions.lineage import cut
from weftgraph.operators.compare import classify
from weftgraph.operators.components import ends_of, paths_to_ends

# States from the one that hides the others down, and what properties are compared.
STATES = ["type_conflict", "missing", "renamed", "moved", "different", "same"]
IGNORED = [
    "raw_source", "dax_ast", "source_hash", "lineage_tag", "lineageTag", "check_status", "not_checked_reason", "not_checked_detail", "model_ids",
    "field_roles", "binding_evidence", "unresolved_field_refs", "query", "visual_name", "x", "y", "z", "width", "height", "from_ref", "to_ref",
    "origin", "workspace_name", "source_status", "parameters", "sources",
]
SHORT = 40


def filter_rows(rows: DataFrame, types=(), tables=(), folders=(), states=(), sources=(), pages=(), changed: bool | None = None, marks=(), proposal: bool | None = None, text: str = "") -> DataFrame:
    """Rows that meet every criterion given; names fold case.

    ``rows`` has object_type, table, display_folder, row_state, page, changed, marks (array), proposal, name and cells
    (array of source_id, present, name). ``states`` may hold ``not_same`` and ``all``; ``marks`` may hold ``any``. A
    source counts where its cell is present; ``text`` is looked for in the row's and the cells' names.
    """
    low = lambda values: [v.lower() for v in values]
    within = lambda c, values: F.coalesce(F.lower(c).isin(low(values)), F.lit(False))
    tests: list[Column] = [within(c, values) for c, values in (("object_type", types), ("table", tables), ("display_folder", folders), ("page", pages)) if values]
    wanted = {"type_conflict" if s == "conflict" else s for s in low(states)}
    if wanted and "all" not in wanted:
        named = wanted - {"not_same"}
        tests += [F.col("row_state") != "same"] if "not_same" in wanted else []
        tests += [F.col("row_state").isin(sorted(named))] if named else []
    if sources:
        tests.append(F.exists("cells", lambda c: c["source_id"].isin(list(sources)) & c["present"]))
    if changed is not None:
        tests.append(F.col("changed") == changed)
    if marks:
        own = F.lit("any" in low(marks)) | F.arrays_overlap(F.transform("marks", lambda m: F.lower(m)), F.array(*map(F.lit, low(marks))))
        tests.append((F.size("marks") > 0) & own)
    if proposal is not None:
        tests.append((F.coalesce("proposal", F.lit("")) != "") == proposal)
    if text.strip():
        holds = lambda c: F.coalesce(F.lower(c).contains(text.strip().lower()), F.lit(False))
        tests.append(holds(F.col("name")) | F.exists("cells", lambda c: holds(c["name"])))
    return rows.where(reduce(lambda p, q: p & q, tests, F.lit(True)))


def sort_rows(rows: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """``rows`` by state precedence, name, type or table; ties stay in order of ``position``, also where the order falls."""
    state = F.coalesce(*[F.when(F.col("row_state") == s, n) for n, s in enumerate(STATES)], F.lit(len(STATES)))
    place = F.coalesce("table", "page", F.lit(""))
    keys = {"state": [state], "name": [F.lower("name"), F.col("name")], "type": [F.col("object_type")], "table": [F.lower(place), place]}[by]
    return rows.orderBy(*[k.desc() if descending else k.asc() for k in keys], F.col("position").asc())


def state_counts(rows: DataFrame) -> DataFrame:
    """(state, n) for every state, zero where none is in it."""
    told = F.array(*[F.struct(F.lit(s).alias("state"), F.count_if(F.col("row_state") == s).alias("n")) for s in STATES])
    return rows.agg(told.alias("t")).select(F.explode("t").alias("t")).select("t.*")


def renamed(formula: Column, renames: dict[str, str]) -> Column:
    """The formula with the references named in ``renames`` ({"Table[Name]" or "[Name]": new name}) under their new names; others stay."""
    new = F.create_map(*[F.lit(x) for old, name in renames.items() for x in (old.lower(), name)]) if renames else F.create_map(F.lit(""), F.lit(""))

    def one(t: Column) -> Column:
        table, name = reference_table(t), reference_name(t)
        key = F.lower(F.concat(F.coalesce(table, F.lit("")), F.lit("["), name, F.lit("]")))
        return F.when(t.endswith("]") & new[key].isNotNull(), F.concat(F.regexp_extract(t, r"^([^\[]*)\[", 1), F.lit("["), new[key], F.lit("]"))).otherwise(t)

    return F.array_join(F.transform(tokens(formula), one), "")


def compare_properties(target: DataFrame, donor: DataFrame, strict: bool = False, renames: dict[str, str] | None = None) -> DataFrame:
    """(id, property, phrase, old, new, through_rename) of the properties that differ, or are equal only after renaming.

    Both sides have id, property, kind (``dax``, ``text``, ``value``) and value; a property absent on a side is null there.
    Formulas are equal but for layout and case, texts but for line ends and blanks before them, unless ``strict``; values
    must be the same. Long values, and formulas, show the phrase alone.
    """
    side = lambda df, out: df.select("id", "property", F.col("kind").alias(f"{out}_kind"), F.col("value").alias(out))
    both = side(target, "old").join(side(donor, "new"), ["id", "property"], "full_outer").withColumn("kind", F.coalesce("old_kind", "new_kind"))
    dax, text = F.col("kind") == "dax", F.col("kind") == "text"
    as_is = F.col("old").eqNullSafe(F.col("new"))
    alike = lambda f: f(F.col("old")).eqNullSafe(f(F.col("new")))
    equal = as_is if strict else F.when(dax, alike(formula_key)).when(text, alike(plain_text)).otherwise(as_is)
    through = dax & ~equal & formula_key(renamed(F.col("old"), renames or {})).eqNullSafe(formula_key(F.col("new"))) if renames else F.lit(False)
    short = lambda c: F.col(c).isNull() | ((F.length(c) <= SHORT) & ~F.col(c).contains("\n"))
    shown = ~dax & short("old") & short("new") & ~through
    told = both.withColumns({"equal": equal, "through_rename": F.coalesce(through, F.lit(False)), "shown": shown}).where("NOT equal")
    phrase = F.when(F.col("through_rename"), "equal_after_rename").otherwise(F.concat("property", F.lit("_changed")))
    return told.select("id", "property", phrase.alias("phrase"), F.when(F.col("shown"), F.col("old")).alias("old"), F.when(F.col("shown"), F.col("new")).alias("new"), "through_rename")


def compared(properties: Column) -> Column:
    """Of a map of properties those that define an object: no bookkeeping, links or layout; texts trimmed."""
    own = F.map_filter(properties, lambda k, v: ~(k.isin(IGNORED) | k.endswith("_id") | k.endswith("_ids")))
    return F.transform_values(own, lambda k, v: F.trim(v))


def merge_evidence(links: DataFrame, keys: list[str]) -> DataFrame:
    """One link per key, its evidence the distinct texts of all, sorted; pre-aggregated, so a link told often is no hot key."""
    each = links.select(*keys, F.explode_outer("evidence").alias("e"))
    return each.distinct().groupBy(*keys).agg(F.array_sort(F.collect_set("e")).alias("evidence"))


def distinct_json(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(digest, first, copies): records that are equal as JSON, whatever the order of their keys."""
    told = leaves(rows.select(key, json), key, json)
    digest = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("path", "value")))), 256)
    return told.groupBy(key).agg(digest.alias("digest")).groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("copies"))


def compare_snapshots(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(level, id, change) of ``objects``, ``files`` and ``edges`` (id, digest), and (level ``unknown``) of changed files without a changed object.

    ``objects`` also have the ``file`` they come from. Where none is unknown the comparison is complete.
    """
    change = lambda level, key="id": classify(before[level], after[level], key, ["digest"]).where("status <> 'UNCHANGED'")
    told = {level: change(level) for level in ("objects", "files", "edges")}
    homes = before["objects"].select("id", "file").union(after["objects"].select("id", "file")).distinct()
    explained = told["objects"].join(homes, "id").select(F.col("file").alias("id")).distinct()
    unknown = told["files"].join(explained, "id", "left_anti").select(F.lit("unknown").alias("level"), "id", F.lit("UNKNOWN_DIFFERENCE").alias("change"))
    rows = [df.select(F.lit(level).alias("level"), "id", F.col("status").alias("change")) for level, df in told.items()]
    return reduce(DataFrame.unionByName, [*rows, unknown])


def pending_changes(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(path, change) of files (path, digest, size) that are not as they were when stored."""
    return classify(stored, found, "path", ["digest", "size"]).where("status <> 'UNCHANGED'").select("path", F.col("status").alias("change"))


def text_diff(old: Column, new: Column) -> Column:
    """A unified diff of two texts, line by line; empty where they are equal, null counts as empty."""

    def told(a: pd.Series, b: pd.Series) -> pd.Series:
        lines = lambda t: (t or "").splitlines()
        return pd.Series(["\n".join(difflib.unified_diff(lines(x), lines(y), "old", "new", lineterm="", n=1)) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(told, "string")(old, new)


def artifact(kind: Column, model_id: Column, report_id: Column) -> Column:
    """The artifact that an object belongs to: a report before a model, else other."""
    report = report_id.isNotNull() | kind.isin("REPORT", "PAGE", "VISUAL", "BOOKMARK") | kind.endswith("_FILTER") & (kind != "ROLE_FILTER")
    return F.when(F.coalesce(report, F.lit(False)), "report").when(model_id.isNotNull() | (kind == "MODEL"), "model").otherwise("other")


def lineage_view(objects: DataFrame, capped: int = 200, dropped: tuple[str, ...] = ("description",)) -> DataFrame:
    """Compact columns of objects: parser output dropped, texts capped, the definition as a digest."""
    kept = [c for c in objects.columns if c not in dropped and c != "expression"]
    cut = [F.substring(c, 1, capped).alias(c) if kind == "string" and c != "id" else F.col(c) for c, kind in objects.dtypes if c in kept]
    definition = F.when(F.col("expression").isNotNull(), F.substring(F.sha2(formula_key(F.col("expression")), 256), 1, 16))
    return objects.select(*cut, definition.alias("definition_hash"))


def preorder(nodes: DataFrame) -> DataFrame:
    """(id, path): by sorting on ``path`` every object comes right before its children, which come by rank of type and name.

    ``nodes`` have id, parent_id, rank, name. Paths lead down from the objects whose parent is absent, however deep; objects on
    a loop or below one have none.
    """
    step = F.concat(F.lpad(F.col("rank").cast("string"), 2, "0"), F.lit(":"), F.lower("name"), F.lit(":"), F.col("id"))
    own = cut(nodes.select("id", "parent_id", step.alias("step")))
    roots = own.join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id", F.lit(True).alias("root"))
    marked = own.join(roots.distinct(), "id", "left").select("id", F.when(F.col("root"), F.col("id")).otherwise(F.col("parent_id")).alias("next"), F.coalesce("root", F.lit(False)).alias("done"), "step")
    steps = cut(marked)
    return paths_to_ends(steps.join(ends_of(steps).select("id"), "id", "left_semi"))


def synced_pairs(members: DataFrame) -> DataFrame:
    """(report_id, group_name, from_id, to_id): slicers of one sync group, each pair once, by id.

    Pairs are the answer here; a group is the slicers that a person put together on one report.
    """
    a = members.select("report_id", "group_name", F.col("id").alias("from_id"))
    b = members.select("report_id", "group_name", F.col("id").alias("to_id"))
    return a.join(b, ["report_id", "group_name"]).where("from_id < to_id")


def page_links(visuals: DataFrame, pages: DataFrame) -> DataFrame:
    """(from_id, to_id) of visuals (id, report_id, parent_id, page_ref) that name a page of their report, not their own.

    ``pages`` have id, report_id and names (array) in order of precedence; of equal names the first page by id counts.
    """
    key = lambda c: F.trim(F.lower(c))
    named = pages.select("id", "report_id", F.posexplode("names").alias("rank", "name")).where("name IS NOT NULL")
    first = named.groupBy("report_id", key(F.col("name")).alias("key")).agg(F.min(F.struct("id", "rank")).alias("p")).select("report_id", "key", F.col("p.id").alias("to_id"))
    asked = visuals.where("page_ref IS NOT NULL").select(F.col("id").alias("from_id"), "report_id", "parent_id", key(F.col("page_ref")).alias("key"))
    return asked.join(first, ["report_id", "key"]).where("NOT (to_id <=> parent_id)").select("from_id", "to_id")
