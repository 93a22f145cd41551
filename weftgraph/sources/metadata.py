"""Model files to graph tables, and the sinks of a graph: manifest, content id, canonical JSON, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CHILD = "id string, name string, description string"
_WITH_TEXT = f"array<struct<{_CHILD}, expression string>>"
#: A model file as it is read; a fixed schema, so that no pass over the files infers one.
MODEL = f"""{_CHILD}, tables array<struct<{_CHILD}, columns array<struct<{_CHILD}, dataType string>>, measures array<struct<{_CHILD}, expression string>>,
    hierarchies array<struct<{_CHILD}, levels array<struct<{_CHILD}, column string>>>>, partitions {_WITH_TEXT}>>,
  relationships array<struct<id string, fromTable string, fromColumn string, toTable string, toColumn string, isActive boolean>>,
  roles array<struct<{_CHILD}, tablePermissions array<struct<{_CHILD}, table string, filterExpression string>>>>,
  fieldParameters array<struct<{_CHILD}, entries array<struct<name string, `order` int, objectId string>>>>,
  sharedExpressions {_WITH_TEXT}, userDefinedFunctions {_WITH_TEXT},
  calculationGroups array<struct<{_CHILD}, precedence int, calculationItems array<struct<{_CHILD}, expression string, ordinal int>>>>"""
_FILTERS = "filters array<struct<id string, condition string, target struct<objectId: string>>>"
REPORT = f"""id string, name string, modelId string, {_FILTERS}, bookmarks array<struct<id string, displayName string>>,
  sections array<struct<id string, displayName string, {_FILTERS},
    visualContainers array<struct<id string, visualType string, title string, {_FILTERS}, fields array<struct<objectId string, kind string>>>>>>"""


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Models of JSON files that hold one object or an array of them."""
    return spark.read.schema(MODEL).json(path, multiLine=True)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path, multiLine=True)


def _node(id_: Column, kind: str, name: Column, parent: Column, home: Column, text: Column | None = None) -> Column:
    return F.struct(id_.alias("id"), F.lit(kind).alias("type"), name.alias("name"), parent.alias("parent_id"), home.alias("home_id"), (F.lit(None).cast("string") if text is None else text).alias("text"))


def _each(items: Column, make) -> Column:
    """``make`` of every item; of a null list nothing."""
    return F.coalesce(F.transform(items, make), F.array())


def model_nodes(models: DataFrame) -> DataFrame:
    """(id, type, name, parent_id, home_id, text) of models and all that they hold, from one scan; objects without an id are left out.

    Children follow their parents: a table's columns, measures, hierarchies with levels and partitions; a role's filters; a
    calculation group's items.
    """
    m, none = F.col("id"), F.lit(None).cast("string")
    plain = lambda items, kind, parent, text=None: _each(items, lambda x: _node(x["id"], kind, x["name"], parent, m, x[text] if text else None))
    nested = lambda items, make: F.flatten(_each(items, make))
    in_table = lambda t: F.concat(
        plain(t["columns"], "COLUMN", t["id"]), plain(t["measures"], "MEASURE", t["id"], "expression"), plain(t["hierarchies"], "HIERARCHY", t["id"]),
        nested(t["hierarchies"], lambda h: plain(h["levels"], "LEVEL", h["id"], "column")), plain(t["partitions"], "PARTITION", t["id"], "expression"),
    )
    every = F.concat(
        F.array(_node(m, "MODEL", F.col("name"), none, m)), plain(F.col("tables"), "TABLE", m), nested(F.col("tables"), in_table),
        _each(F.col("relationships"), lambda r: _node(r["id"], "RELATIONSHIP", none, m, m)),
        plain(F.col("roles"), "SECURITY_ROLE", m), nested(F.col("roles"), lambda r: plain(r["tablePermissions"], "ROLE_FILTER", r["id"], "filterExpression")),
        plain(F.col("fieldParameters"), "FIELD_PARAMETER", m), plain(F.col("sharedExpressions"), "SHARED_EXPRESSION", m, "expression"),
        plain(F.col("userDefinedFunctions"), "USER_DEFINED_FUNCTION", m, "expression"), plain(F.col("calculationGroups"), "CALCULATION_GROUP", m),
        nested(F.col("calculationGroups"), lambda g: plain(g["calculationItems"], "CALCULATION_ITEM", g["id"], "expression")),
    )
    return models.select(F.explode(every).alias("n")).select("n.*").where("id is not null")


def _filter_nodes(items: Column, kind: str, parent: Column, home: Column) -> Column:
    return _each(items, lambda f: _node(f["id"], kind, F.lit(None).cast("string"), parent, home, f["condition"]))


def report_nodes(reports: DataFrame) -> DataFrame:
    """(id, type, name, parent_id, home_id, text) of reports, pages, visuals, bookmarks, and the filters at each of them."""
    r, none = F.col("id"), F.lit(None).cast("string")
    visuals = lambda p: F.concat(
        _each(p["visualContainers"], lambda v: _node(v["id"], "VISUAL", v["title"], p["id"], r, v["visualType"])),
        F.flatten(_each(p["visualContainers"], lambda v: _filter_nodes(v["filters"], "VISUAL_FILTER", v["id"], r))),
        _filter_nodes(p["filters"], "PAGE_FILTER", p["id"], r),
    )
    every = F.concat(
        F.array(_node(r, "REPORT", F.col("name"), none, r)), _each(F.col("sections"), lambda p: _node(p["id"], "PAGE", p["displayName"], r, r)), F.flatten(_each(F.col("sections"), visuals)),
        _filter_nodes(F.col("filters"), "REPORT_FILTER", r, r), _each(F.col("bookmarks"), lambda b: _node(b["id"], "BOOKMARK", b["displayName"], r, r)),
    )
    return reports.select(F.explode(every).alias("n")).select("n.*").where("id is not null")


def filter_targets(reports: DataFrame) -> DataFrame:
    """(from_id, to_id, type) from filters, wherever they stand, to what they filter; each edge once."""
    of = lambda items: _each(items, lambda f: F.struct(f["id"].alias("from_id"), f["target"]["objectId"].alias("to_id"), F.lit("FILTERS").alias("type")))
    on_pages = F.flatten(_each(F.col("sections"), lambda p: F.concat(of(p["filters"]), F.flatten(_each(p["visualContainers"], lambda v: of(v["filters"]))))))
    return reports.select(F.explode(F.concat(of(F.col("filters")), on_pages)).alias("e")).select("e.*").dropna().distinct()


def containment(nodes: DataFrame) -> DataFrame:
    """(from_id, to_id, type) from parents to children."""
    return nodes.where("parent_id is not null").select(F.col("parent_id").alias("from_id"), F.col("id").alias("to_id"), F.lit("CONTAINS").alias("type"))


def usage(reports: DataFrame) -> DataFrame:
    """(from_id, to_id, type) from visuals to what they show, and from reports to their model; each edge once."""
    shown = F.flatten(_each(F.col("sections"), lambda p: F.flatten(_each(p["visualContainers"], lambda v: _each(v["fields"], lambda f: F.struct(v["id"].alias("from_id"), f["objectId"].alias("to_id"), F.lit("USES").alias("type")))))))
    home = F.array(F.struct(F.col("id").alias("from_id"), F.col("modelId").alias("to_id"), F.lit("USES_MODEL").alias("type")))
    return reports.select(F.explode(F.concat(shown, home)).alias("e")).select("e.*").dropna().distinct()


def relations(models: DataFrame) -> DataFrame:
    """(from_id, to_id, type) between a relationship and its two columns."""
    ends = F.flatten(_each(F.col("relationships"), lambda r: F.array(F.struct(r["id"].alias("from_id"), r["fromColumn"].alias("to_id"), F.lit("RELATES_FROM").alias("type")), F.struct(r["id"].alias("from_id"), r["toColumn"].alias("to_id"), F.lit("RELATES_TO").alias("type")))))
    return models.select(F.explode(ends).alias("e")).select("e.*").dropna()


def manifest(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, sha256, size) of the files under ``path``; the path is told from ``path`` on."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.substring_index("path", f"{path.rstrip('/')}/", -1).alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def content_id(rows: DataFrame) -> DataFrame:
    """(rows, content_id): one digest of a table as a bag; the order of rows and columns does not count.

    Row digests are added up in four 60-bit parts, so the sum is a partial aggregate and nothing is sorted.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    sums = rows.select(row.alias("d")).agg(F.count("*").alias("rows"), *[F.coalesce(part(i), F.lit("0")).alias(f"s{i}") for i in range(4)])
    return sums.select("rows", F.concat(F.lit("snapshot:"), F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[f"s{i}" for i in range(4)]), 256)).alias("content_id"))


def write_canonical(rows: DataFrame, path: str) -> None:
    """One JSON object a line, columns by name and rows by id over all files; a range sort, not one task."""
    rows.select(*sorted(rows.columns)).orderBy("id").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_canonical(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def card_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, place, line): a heading and a line per edge for every object; lines stay rows, however many a hub has."""
    head = nodes.select("id", F.lit(0).alias("place"), F.concat(F.lit("# "), F.coalesce("name", "id"), F.lit(" ("), F.col("type"), F.lit(")")).alias("line"))
    line = lambda at, other, word, place: edges.select(F.col(at).alias("id"), F.lit(place).alias("place"), F.concat_ws(" ", F.lit(word), F.col("type"), F.col(other)).alias("line"))
    return head.union(line("from_id", "to_id", "out", 1)).union(line("to_id", "from_id", "in", 2)).dropna(subset=["id"])


def write_cards(lines: DataFrame, path: str, files: int = 64) -> None:
    lines.repartitionByRange(files, "id", "place", "line").sortWithinPartitions("id", "place", "line").select("line").write.mode("overwrite").text(path)


def ask_index(objects: DataFrame) -> DataFrame:
    """(key, n, first): folded type and name of objects (id, type, name), how many bear it and the smallest id."""
    return objects.dropna(subset=["name"]).groupBy(F.concat_ws("|", F.lower("type"), F.lower("name")).alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


def wiring(objects: DataFrame, links: DataFrame) -> DataFrame:
    """(from_type, type, to_type, n): which types are linked with which."""
    kinds = objects.select("id", F.col("type").alias("kind"))
    both = links.join(kinds.toDF("from_id", "from_type"), "from_id").join(kinds.toDF("to_id", "to_type"), "to_id")
    return both.groupBy("from_type", "type", "to_type").agg(F.count("*").alias("n"))
