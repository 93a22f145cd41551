"""Impact of a change by ten rules, what stays unknown, tests to run, and the items' filters and facets.

Objects have id, type, name, model_id, report_id and parent_id (a column's or measure's table), relationships
also from_column_id and to_column_id, calculations behaviors (array of function names). Links have type,
from_id, to_id and evidence_class. Nulls reach nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.lineage import Rounds, cut
from weftgraph.operators import traversal

# Fixed values.
CONSUMERS = ["DEPENDS_ON", "REFERENCES", "USES", "USES_MODEL", "FILTERS", "MODIFIES_FILTER", "ACTIVATES_RELATIONSHIP", "MODIFIES_RELATIONSHIP", "SOURCES_FROM"]
CALCULATIONS = ["MEASURE", "CALCULATION_ITEM", "COLUMN", "TABLE", "SHARED_EXPRESSION", "USER_DEFINED_FUNCTION", "VISUAL_CALCULATION", "REPORT_MEASURE", "ROLE_FILTER"]
SECURITY = ["ROLE", "SECURITY_ROLE", "ROLE_FILTER", "OLS_PERMISSION", "TABLE_PERMISSION", "ROW_LEVEL_SECURITY", "OBJECT_LEVEL_SECURITY"]
MODEL_WIDE = ["MODEL", "TABLE", "COLUMN", "USER_DEFINED_FUNCTION", "FIELD_PARAMETER", "CALCULATION_GROUP", "CALCULATION_ITEM", "SHARED_EXPRESSION", "PARTITION", *SECURITY]
REPORT_TYPES = ["VISUAL", "PAGE", "REPORT", "VISUAL_FILTER", "PAGE_FILTER", "REPORT_FILTER", "VISUAL_CALCULATION", "REPORT_MEASURE", "BOOKMARK"]
PART_OF = {"LEVEL": "HIERARCHY", "PARTITION": "TABLE", "ROLE_FILTER": "SECURITY_ROLE", "OLS_PERMISSION": "SECURITY_ROLE"}
ANYWHERE = ["CALCULATION_ITEM", "USER_DEFINED_FUNCTION", "SHARED_EXPRESSION"]
OVERRIDES = ["USERELATIONSHIP", "CROSSFILTER", "ALL", "REMOVEFILTERS", "TREATAS"]
TESTED = ["MEASURE", "CALCULATION_ITEM", "VISUAL", "USER_DEFINED_FUNCTION"]
TESTS = [
    "unfiltered_total", "grouped_dimension_total", "affected_measure", "dependent_measure", "alternate_relationship", "blank_unmatched_keys",
    "slicer_filter_context", "time_intelligence", "report_bound_calculation",
]
_RECORD = ["root", "object_id", "rule", "category", "depth", "fact"]


def _steps(objects: DataFrame, links: DataFrame, with_reports: bool) -> DataFrame:
    """(at, id, rule, fact): every way on from an affected object, whatever the target."""
    types = objects.select("id", "type")
    ends = (
        links.select("from_id", "to_id", F.col("type").alias("link"), (F.coalesce("evidence_class", F.lit("FACT")) == "FACT").alias("fact"))
        .join(types.toDF("from_id", "from_type"), "from_id").join(types.toDF("to_id", "to_type"), "to_id")
    )
    held = F.col("link") == "CONTAINS"
    parts = reduce(lambda p, q: p | q, [(F.col("to_type") == part) & (F.col("from_type") == whole) for part, whole in PART_OF.items()])
    down = lambda rule, when: F.when(when, F.struct(F.col("from_id").alias("at"), F.col("to_id").alias("id"), F.lit(rule).alias("rule"), "fact"))
    up = lambda rule, when, sure: F.when(when, F.struct(F.col("to_id").alias("at"), F.col("from_id").alias("id"), F.lit(rule).alias("rule"), sure.alias("fact")))
    true = F.lit(True)
    reports = F.lit(with_reports)
    ways = [
        down("contained_scope", held & F.col("from_type").isin("MODEL", "TABLE", "CALCULATION_GROUP")),
        up("consumer_closure", F.col("link").isin(CONSUMERS) & (reports | ~F.col("from_type").isin(REPORT_TYPES)), F.col("fact")),
        up("definition_ancestry", held & parts, true),
        up("report_ancestry", held & ~parts & reports & F.col("to_type").isin(REPORT_TYPES), true),
    ]
    return cut(ends.select(F.explode(F.array_compact(F.array(*ways))).alias("s")).select("s.*"))


def _records(df: DataFrame, root: str, object_id: str, rule: Column, category: str, depth: int, fact: bool) -> DataFrame:
    return df.select(F.col(root).alias("root"), F.col(object_id).alias("object_id"), rule.alias("rule"), F.lit(category).alias("category"), F.lit(depth).alias("depth"), F.lit(fact).alias("fact"))


def _relationship_parts(objects: DataFrame, links: DataFrame, targets: DataFrame, changes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Records of changed relationships, and (root, id) of the calculations that their filter context may change."""
    own = targets.where("type = 'RELATIONSHIP'").select("root", "from_column_id", "to_column_id", "model_id")
    new = changes.where("property IN ('from_column_id', 'to_column_id')").select(F.col("object_id").alias("root"), F.col("new_value").alias("id"))
    ends = own.select("root", F.explode(F.array("from_column_id", "to_column_id")).alias("id")).union(new.join(own.select("root"), "root", "left_semi")).dropna().distinct()
    columns = objects.where("type = 'COLUMN'").select("id", F.col("parent_id").alias("table_id"))
    # tables joined by any relationship, active or not, before and after the change; both ways
    every = objects.where("type = 'RELATIONSHIP'").select(F.col("id").alias("rel"), "from_column_id", "to_column_id")
    later = every
    for end in ("from_column_id", "to_column_id"):
        value = changes.where(F.col("property") == end).select(F.col("object_id").alias("rel"), F.col("new_value").alias("new"))
        later = later.join(value, "rel", "left").withColumn(end, F.coalesce("new", end)).drop("new")
    both = every.select("from_column_id", "to_column_id").union(later.select("from_column_id", "to_column_id")).distinct()
    home = lambda c, out: columns.select(F.col("id").alias(c), F.col("table_id").alias(out))
    joined = both.join(home("from_column_id", "from_id"), "from_column_id").join(home("to_column_id", "to_id"), "to_column_id").select("from_id", "to_id", F.lit("FILTERS").alias("type"))
    start = ends.join(columns, "id").select("root", F.col("table_id").alias("id")).dropna().distinct()
    reached = _reach(traversal.either_way(joined).distinct(), start)
    # calculations of the model that touch a reached table, or whose reads are not known
    calc = objects.where(F.col("type").isin(CALCULATIONS)).select("id", "type", "model_id", "parent_id")
    reads = links.where(F.col("type").isin(CONSUMERS)).select(F.col("from_id").alias("id"), F.col("to_id").alias("read"))
    touched = reads.join(objects.select(F.col("id").alias("read"), F.coalesce(F.when(F.col("type") == "TABLE", F.col("id")), F.col("parent_id")).alias("table_id")), "read").select("id", "table_id")
    near = touched.union(calc.select("id", F.col("parent_id").alias("table_id"))).union(calc.where("type = 'TABLE'").select("id", F.col("id").alias("table_id"))).dropna().distinct()
    touching = near.join(reached.select("root", F.col("id").alias("table_id")), "table_id").select("root", "id").distinct()
    blind = calc.where(~F.col("type").isin("COLUMN", "TABLE")).join(reads.select("id").distinct(), "id", "left_anti").select("id", "model_id").union(calc.where(F.col("type").isin(ANYWHERE)).select("id", "model_id"))
    scoped = own.select("root", "model_id").join(blind.distinct(), "model_id").select("root", "id")
    in_model = calc.select("id", "model_id").join(own.select("root", "model_id"), "model_id").select("root", "id")
    context = cut(touching.union(scoped).distinct().join(in_model, ["root", "id"], "left_semi"))
    acts = context.join(objects.select("id", F.explode("behaviors").alias("function")), "id").where(F.col("function").isin(OVERRIDES)).distinct()
    return [
        _records(ends, "root", "id", F.lit("relationship_endpoint"), "STRUCTURAL", 1, True),
        _records(reached, "root", "id", F.lit("filter_influence"), "POTENTIAL_BEHAVIORAL", 1, False),
        _records(context, "root", "id", F.lit("calculation_context"), "POTENTIAL_BEHAVIORAL", 1, False),
        _records(acts, "root", "id", F.concat(F.lit("dax_override:"), "function"), "CONDITIONAL", 1, False),
    ], context


def _reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(root, id) of all that the (root, id) of ``start`` reach."""
    links, found = cut(edges.select(F.col("from_id").alias("id"), "to_id")), Rounds(start)
    frontier = found.all()
    while not frontier.isEmpty():
        step = frontier.join(links, "id").select("root", F.col("to_id").alias("id")).distinct()
        frontier = found.add(step.join(found.all(), ["root", "id"], "left_anti"))
    return found.all()


def impact(objects: DataFrame, links: DataFrame, targets: list[str], changes: DataFrame | None = None, with_reports: bool = True) -> DataFrame:
    """(root, object_id, rule, category, evidence_class, depth): a record per object, target and rule, of its shortest path.

    A record is INFERRED where its category is past STRUCTURAL or a step on the way is analytical or no fact. ``changes``
    (object_id, property, new_value) are the proposed ones. The closure runs until nothing new is reached.
    """
    spark = objects.sparkSession
    changes = changes if changes is not None else spark.createDataFrame([], "object_id string, property string, new_value string")
    objects = cut(objects)
    own = objects.where(F.col("id").isin(targets)).withColumn("root", F.col("id"))
    steps = _steps(objects, links, with_reports)
    told = [_records(own, "root", "id", F.lit("seed"), "DIRECT", 0, True)]
    calc = objects.where(F.col("type").isin(CALCULATIONS)).select("id", "model_id")
    wide = own.where(F.col("type").isin(MODEL_WIDE)).select("root", "model_id").join(calc, "model_id").select("root", "id")
    told.append(_records(wide, "root", "id", F.lit("model_context"), "POTENTIAL_BEHAVIORAL", 1, False))
    parts, context = _relationship_parts(objects, links, own, changes)
    told += parts
    seeds = own.select("root", "id", F.lit(0).alias("depth"), F.lit(True).alias("fact"))
    late = cut(wide.union(context).distinct().select("root", "id", F.lit(1).alias("depth"), F.lit(False).alias("fact")))
    found, at = Rounds(seeds), 0
    frontier = found.all()
    while True:
        at += 1
        step = frontier.join(steps.withColumnRenamed("fact", "sure"), frontier["id"] == steps["at"]).select("root", steps["id"], (F.col("fact") & F.col("sure")).alias("fact"))
        new = (step.unionByName(late.select("root", "id", "fact")) if at == 1 else step).groupBy("root", "id").agg(F.max("fact").alias("fact"))
        frontier = found.add(new.join(found.all().select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(at).alias("depth"), "fact"))
        if not found.added:
            break
    visited = found.all().withColumnRenamed("fact", "way")
    kinds = own.select("root", F.col("type").alias("root_type"))
    hit = visited.withColumnRenamed("id", "at").join(steps, "at").join(kinds, "root")
    category = F.when((F.col("rule") == "consumer_closure") & (F.col("root_type") == "RELATIONSHIP"), "POTENTIAL_BEHAVIORAL").otherwise("STRUCTURAL")
    told.append(hit.select("root", F.col("id").alias("object_id"), "rule", category.alias("category"), (F.col("depth") + 1).alias("depth"), (F.col("way") & F.col("fact")).alias("fact")))
    every = reduce(DataFrame.unionByName, [t.select(*_RECORD) for t in told])
    best = every.groupBy("root", "object_id", "rule", "category").agg(F.min(F.struct("depth", (~F.col("fact")).alias("guess"))).alias("b"))
    inferred = F.col("category").isin("CONDITIONAL", "POTENTIAL_BEHAVIORAL", "UNKNOWN") | F.col("b.guess")
    return best.select("root", "object_id", "rule", "category", F.when(inferred, "INFERRED").otherwise("FACT").alias("evidence_class"), F.col("b.depth").alias("depth"))


#: What a scan may say of an object that it could not read in full. Fixed values.
FINDINGS = ["unresolved_references", "unresolved_fields", "unresolved_bindings", "dax_diagnostics", "diagnostics"]


def unread(objects: DataFrame, models: list[str], targets: DataFrame, relations: DataFrame, findings: DataFrame, queries: DataFrame) -> DataFrame:
    """(reason, object_id) of what else an impact on ``targets`` (id) cannot see.

    ``relations`` (id, from_column_id, to_column_id) of which an end is no column, or is a column whose table (``parent_id``) is gone; ``findings`` (object_id,
    finding: one of ``FINDINGS``) on objects of ``models`` and on reports; and, where a target is a data source, every one of ``queries`` (id) that was not read, for
    each may read it.
    """
    columns = objects.where("type = 'COLUMN'").select(F.col("id").alias("end"), "parent_id")
    tables = objects.select(F.col("id").alias("parent_id"), F.lit(True).alias("held")).distinct()
    ends = relations.select("id", F.explode(F.array("from_column_id", "to_column_id")).alias("end")).join(columns.withColumn("known", F.lit(True)), "end", "left").join(tables, "parent_id", "left")
    told = ends.groupBy("id").agg(F.count("known").alias("known"), F.count("held").alias("held"))
    reason = F.when(F.col("known") < 2, "UNRESOLVED_RELATIONSHIP").when(F.col("held") < 2, "MISSING_ENDPOINT_TABLE")
    crooked = told.select(reason.alias("reason"), F.col("id").alias("object_id")).where("reason IS NOT NULL")
    seen = objects.where(F.col("model_id").isin(models) | (F.col("type") == "REPORT")).select(F.col("id").alias("object_id"))
    odd = findings.where(F.col("finding").isin(FINDINGS)).join(seen, "object_id", "left_semi").select(F.upper("finding").alias("reason"), "object_id").distinct()
    sources = objects.where("type = 'DATA_SOURCE'").join(targets, "id", "left_semi").limit(1).select(F.lit(1).alias("one"))
    dark = queries.select(F.lit("UNREAD_M_QUERY").alias("reason"), F.col("id").alias("object_id"), F.lit(1).alias("one")).join(sources, "one", "left_semi").drop("one")
    return crooked.unionByName(odd).unionByName(dark)


def completeness(unknown: DataFrame, scanned: bool = True) -> DataFrame:
    """(status, reason, objects): how many objects each reason of ``unknown`` (reason, object_id) leaves open; one row without a reason if there are none.

    An impact is COMPLETE only if nothing is open and the scan below it was complete (``scanned``).
    """
    open_ = unknown.groupBy("reason").agg(F.countDistinct("object_id").alias("objects"))
    none = unknown.sparkSession.range(1).select(F.lit(None).cast("string").alias("reason"), F.lit(0).cast("long").alias("objects"))
    alone = none.withColumn("k", F.lit(1)).join(open_.limit(1).select(F.lit(1).alias("k")), "k", "left_anti").drop("k")
    status = F.when(F.col("reason").isNotNull() | F.lit(not scanned), "INCOMPLETE").otherwise("COMPLETE")
    return open_.unionByName(alone).select(status.alias("status"), "reason", "objects")


def unknowns(objects: DataFrame, links: DataFrame, models: list[str]) -> DataFrame:
    """(reason, object_id) of what an impact on ``models`` cannot see: absent ends, reports without a model, visuals whose fields are not resolved; ``unread`` has the rest."""
    ends = links.select(F.explode(F.array("from_id", "to_id")).alias("object_id")).dropna().distinct()
    lost = ends.join(objects.select(F.col("id").alias("object_id")), "object_id", "left_anti").select(F.lit("DANGLING_GRAPH_ENDPOINT").alias("reason"), "object_id")
    loose = objects.where("type = 'REPORT' AND model_id IS NULL").select(F.lit("UNRESOLVED_REPORT_MODEL").alias("reason"), F.col("id").alias("object_id"))
    own = objects.where((F.col("type") == "VISUAL") & F.col("model_id").isin(models))
    blind = own.join(links.where("type = 'USES'").select(F.col("from_id").alias("id")), "id", "left_anti").select(F.lit("UNRESOLVED_VISUAL_BINDING").alias("reason"), F.col("id").alias("object_id"))
    return lost.unionByName(loose).unionByName(blind)


def required_tests(records: DataFrame, objects: DataFrame) -> DataFrame:
    """(category, targets): each category of tests and how many affected objects it must cover; one more where a security object is affected."""
    types = objects.select(F.col("id").alias("object_id"), "type")
    kinds = records.select("object_id").distinct().join(types, "object_id")
    told = kinds.agg(F.count_if(F.col("type").isin(TESTED)).alias("targets"), F.max(F.col("type").isin(SECURITY)).alias("secured"))
    names = F.array(*map(F.lit, TESTS))
    every = F.when(F.col("secured"), F.array_append(names, F.lit("security_role"))).otherwise(names)
    return told.where("targets > 0").select(F.explode(every).alias("category"), "targets")


def items(records: DataFrame, objects: DataFrame, gone: Column) -> DataFrame:
    """Records as items: direction, severity, certainty and blocking, with the object's type, name and source.

    Certain are DIRECT and STRUCTURAL facts. Of certain ones those on deleted or renamed roots (``gone``, over root) break and
    block, the others change a value; all that is not certain wants a review and never blocks.
    """
    certain = F.col("category").isin("DIRECT", "STRUCTURAL") & (F.col("evidence_class") == "FACT")
    severity = F.when(~certain, "needs_review").when(gone, "breaks").otherwise("changes_value")
    own = objects.select(F.col("id").alias("object_id"), F.col("type").alias("object_type"), "name", F.coalesce("report_id", "model_id").alias("source_id"))
    told = records.withColumns({"severity": severity, "certainty": F.when(certain, "certain").otherwise("possible"), "direction": F.lit("breaks")})
    return told.withColumn("blocking", F.col("severity") == "breaks").join(own, "object_id")


def filter_items(rows: DataFrame, direction: str | None = None, blocking: bool | None = None, severity: str | None = None, certainty: str | None = None, source: str | None = None, object_type: str | None = None, text: str | None = None) -> DataFrame:
    wanted = {"direction": direction, "severity": severity, "certainty": certainty, "source_id": source, "object_type": object_type, "blocking": blocking}
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if text:
        rows = rows.where(F.lower("name").contains(text.lower()) | F.lower("rule").contains(text.lower()))
    return rows


#: Values that a facet lists even where no item has them. Fixed values.
ALWAYS = {"direction": ["breaks", "needs"], "blocking": ["true", "false"], "certainty": ["certain", "possible"], "severity": [], "object_type": []}


def facets(rows: DataFrame) -> DataFrame:
    """(facet, value, n) over all ``rows``, from one pass; fixed values are listed with zero too."""
    each = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in ALWAYS])
    counted = rows.select(F.explode(each).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
    fixed = rows.sparkSession.createDataFrame([(f, v) for f, vs in ALWAYS.items() for v in vs], "facet string, value string")
    return fixed.join(counted, ["facet", "value"], "full_outer").select("facet", "value", F.coalesce("n", F.lit(0)).alias("n"))
