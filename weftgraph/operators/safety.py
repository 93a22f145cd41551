"""A change held against the graph: what it does to objects, what breaks, what it needs, and what it reads upstream.

Objects have id, type, name, model_id, parent_id (a column's or measure's table) and expression, links
type, from_id and to_id. A rename keeps its id; one without is a deletion and a creation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.expressions import references
from weftgraph.functions.keys import fingerprint
from weftgraph.operators.analysis import CONSUMERS
from weftgraph.operators.impact import upstream

# Fixed values.
USING = [*CONSUMERS, "RELATES_TO", "FORMATS_BY", "DRILLS_THROUGH_TO", "TOOLTIP_PAGE"]
FORMULA_TYPES = ["MEASURE", "COLUMN", "TABLE", "CALCULATION_ITEM", "USER_DEFINED_FUNCTION", "ROLE_FILTER", "REPORT_MEASURE", "VISUAL_CALCULATION"]
VERDICTS = ["BREAKS", "NEEDS", "CHANGED", "UNCHANGED"]
UPSTREAM = ["DEPENDS_ON", "REFERENCES", "USES", "FILTERS", "SOURCES_FROM"]
CONTAINERS = ["MODEL", "TABLE", "REPORT", "PAGE", "VISUAL"]


def object_changes(before: DataFrame, after: DataFrame, values: list[str]) -> DataFrame:
    """(object_id, type, change, old_name, name): created, deleted, renamed or changed; what is as it was has no row."""
    side = lambda df, out: df.select("id", F.col("type").alias(f"{out}_type"), F.coalesce("name", F.lit("")).alias(f"{out}_name"), fingerprint(*map(F.col, values)).alias(f"{out}_print"))
    both = side(before, "old").join(side(after, "new"), "id", "full_outer")
    change = (
        F.when(F.col("old_print").isNull(), "created").when(F.col("new_print").isNull(), "deleted")
        .when(F.col("old_name") != F.col("new_name"), "renamed").when(F.col("old_print") != F.col("new_print"), "changed")
    )
    return both.select(F.col("id").alias("object_id"), F.coalesce("new_type", "old_type").alias("type"), change.alias("change"), F.col("old_name").alias("old_name"), F.col("new_name").alias("name")).where("change IS NOT NULL")


def find_breaks(links_before: DataFrame, links_after: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """(user, used, reason): objects that stay and used a deleted object, or used a renamed one and no link after the change leads there."""
    pairs = lambda e: e.where(F.col("type").isin(USING)).select(F.col("from_id").alias("user"), F.col("to_id").alias("used")).where("user <> used").distinct()
    stays = pairs(links_before).join(after.select(F.col("id").alias("user")), "user", "left_semi")
    of = lambda kind: changes.where(F.col("change") == kind).select(F.col("object_id").alias("used"))
    lost = stays.join(of("deleted"), "used", "left_semi").select("user", "used", F.lit("uses_deleted").alias("reason"))
    old = stays.join(of("renamed"), "used", "left_semi").join(pairs(links_after), ["user", "used"], "left_anti")
    return lost.unionByName(old.select("user", "used", F.lit("uses_old_name").alias("reason")))


def find_needs(after: DataFrame, changes: DataFrame) -> DataFrame:
    """(object_id, kind, table, name) of what formulas that are new or changed name and their model lacks.

    A bare name may be a measure or a column; a table's name must be one, its column a column there or a measure of the model.
    Names fold case. Objects without a model are bound otherwise and need nothing here.
    """
    touched = changes.where("change IN ('created', 'changed', 'renamed')").select(F.col("object_id").alias("id"))
    own = after.where(F.col("type").isin(FORMULA_TYPES) & F.col("model_id").isNotNull()).join(touched, "id", "left_semi")
    asked = own.select("id", "model_id", F.explode(references(F.col("expression"))).alias("r")).select("id", "model_id", F.col("r.table").alias("table"), F.trim("r.name").alias("name"))
    asked = asked.withColumns({"t": F.lower("table"), "k": F.lower("name")})
    named = after.select("id", "type", "model_id", "parent_id", F.lower("name").alias("k")).where("k IS NOT NULL")
    plain = named.where("type IN ('MEASURE', 'COLUMN')").select("model_id", "k").distinct().withColumn("plain", F.lit(True))
    measures = named.where("type = 'MEASURE'").select("model_id", "k").distinct().withColumn("measure", F.lit(True))
    tables = named.where("type = 'TABLE'").select("id", "model_id", F.col("k").alias("t"))
    homes = tables.select("model_id", "t").distinct().withColumn("home", F.lit(True))
    inside = named.where("type = 'COLUMN'").select("k", F.col("parent_id").alias("id")).join(tables, "id").select("model_id", "t", "k").distinct().withColumn("column", F.lit(True))
    told = asked.join(plain, ["model_id", "k"], "left").join(measures, ["model_id", "k"], "left").join(homes, ["model_id", "t"], "left").join(inside, ["model_id", "t", "k"], "left")
    kind = (
        F.when(F.col("t").isNull(), F.when(F.col("plain").isNull(), "measure_or_column"))
        .when(F.col("home").isNull(), "table").when(F.col("column").isNull() & F.col("measure").isNull(), "column")
    )
    lacks = told.withColumn("kind", kind).where("kind IS NOT NULL")
    return lacks.select(F.col("id").alias("object_id"), "kind", "table", F.when(F.col("kind") != "table", F.col("name")).alias("name")).distinct()


def assess(changes: DataFrame, breaks: DataFrame, needs: DataFrame) -> DataFrame:
    """One row (status, changes, created, deleted, renamed, changed, breaks, needs): the worst that holds, and exact counts."""
    kinds = ["created", "deleted", "renamed", "changed"]
    counts = changes.agg(F.count("*").alias("changes"), *[F.count_if(F.col("change") == k).alias(k) for k in kinds])
    one = lambda df, out: df.agg(F.count("*").alias(out)).withColumn("k", F.lit(1))
    needy = needs.select("object_id").distinct()
    every = counts.withColumn("k", F.lit(1)).join(one(breaks, "breaks"), "k").join(one(needy, "needs"), "k")
    status = F.when(F.col("breaks") > 0, "BREAKS").when(F.col("needs") > 0, "NEEDS").when(F.col("changes") > 0, "CHANGED").otherwise("UNCHANGED")
    return every.select(status.alias("status"), "changes", *kinds, "breaks", "needs")


def data_sources_of(objects: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """(root, source, depth): the DATA_SOURCE objects that feed each of ``targets`` (id), by a shortest way.

    Ways follow UPSTREAM links forward, containers into their parts, but a table into its partitions alone, and a column back to its
    table. They end at a source.
    """
    kinds = objects.select("id", "type")
    ends = links.join(kinds.toDF("from_id", "from_type"), "from_id").join(kinds.toDF("to_id", "to_type"), "to_id")
    held = (F.col("type") == "CONTAINS") & F.col("from_type").isin(CONTAINERS) & ((F.col("from_type") != "TABLE") | (F.col("to_type") == "PARTITION"))
    on = ends.where(F.col("type").isin(UPSTREAM) | held).select("from_id", "to_id")
    back = objects.where("type = 'COLUMN' AND parent_id IS NOT NULL").select(F.col("id").alias("from_id"), F.col("parent_id").alias("to_id"))
    sources, asked = kinds.where("type = 'DATA_SOURCE'").select("id"), targets.select("id").distinct().join(kinds, "id").select("id")
    own = asked.join(sources, "id", "left_semi").select(F.col("id").alias("root"), F.col("id").alias("source"), F.lit(0).alias("depth"))
    fed = upstream(on.union(back).join(kinds.select(F.col("id").alias("to_id")), "to_id", "left_semi"), asked.join(sources, "id", "left_anti"), sources)
    return own.union(fed.select(F.col("origin").alias("root"), "source", "depth"))


def source_links(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, name, models, queries) of the outside sources that ``queries`` (id, model_id, kind, place) read, and (from_id, to_id, type) links to them.

    One source is one object whoever reads it; its id is the digest of its kind and folded place.
    """
    identity = F.concat_ws("|", F.lower("kind"), F.lower(F.trim("place")))
    own = queries.where("place IS NOT NULL AND trim(place) <> ''").withColumn("source", F.concat(F.lit("source:"), F.substring(F.sha2(identity, 256), 1, 16)))
    nodes = own.groupBy(F.col("source").alias("id")).agg(F.min(F.trim("place")).alias("name"), F.countDistinct("model_id").alias("models"), F.count("*").alias("queries"))
    return nodes, own.select(F.col("id").alias("from_id"), F.col("source").alias("to_id"), F.lit("SOURCES_FROM").alias("type")).distinct()
