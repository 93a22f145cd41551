"""Compare-row, property, snapshot, link and order queries; registers with ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import comparing
from weftgraph.plans.queries import query
from weftgraph.sources.catalog import CATALOG_SQL, links, objects
from weftgraph.sources.star import table

# Every measure against three donors: what differs follows from its own columns.
_ROWS_SQL = """rows AS (SELECT 'row:' || p_partkey AS row_key, p_partkey AS position, 'measure' AS object_type, p_brand AS "table", p_type AS display_folder, NULL::VARCHAR AS page, p_name AS name,
    CASE WHEN p_size % 6 = 0 THEN 'type_conflict' WHEN p_size % 6 = 1 THEN 'missing' WHEN p_size % 6 = 2 THEN 'renamed' WHEN p_size % 6 = 3 THEN 'moved' WHEN p_size % 6 = 4 THEN 'different' ELSE 'same' END AS row_state,
    p_size % 6 <> 5 AS changed, p_partkey % 5 = 0 AS marked, CASE WHEN p_partkey % 7 = 0 THEN 'New ' || p_name END AS proposal, p_partkey % 3 <> 0 AS in_b FROM part)"""


def _rows(spark, d) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey")
    state = F.element_at(F.array(*map(F.lit, comparing.STATES)), (F.col("p_size") % 6 + 1).cast("int"))
    cell = lambda source, present, name: F.struct(F.lit(source).alias("source_id"), present.alias("present"), name.alias("name"))
    return p.select(
        F.concat(F.lit("row:"), k.cast("string")).alias("row_key"), k.alias("position"), F.lit("measure").alias("object_type"), F.col("p_brand").alias("table"), F.col("p_type").alias("display_folder"),
        F.lit(None).cast("string").alias("page"), F.col("p_name").alias("name"), state.alias("row_state"), (state != "same").alias("changed"),
        F.when(k % 5 == 0, F.array(F.lit("Keep"))).otherwise(F.array().cast("array<string>")).alias("marks"), F.when(k % 7 == 0, F.concat(F.lit("New "), "p_name")).alias("proposal"),
        F.array(cell("a", F.lit(True), F.col("p_name")), cell("b", k % 3 != 0, F.upper("p_name"))).alias("cells"),
    )


@query(f"""WITH {_ROWS_SQL}, t AS (
  SELECT 'folder' AS filter, row_key FROM rows WHERE lower(display_folder) IN (SELECT lower(min(p_type)) FROM part)
  UNION ALL SELECT 'not same', row_key FROM rows WHERE row_state <> 'same'
  UNION ALL SELECT 'conflict or moved', row_key FROM rows WHERE row_state IN ('type_conflict', 'moved')
  UNION ALL SELECT 'in b, marked', row_key FROM rows WHERE in_b AND marked
  UNION ALL SELECT 'unchanged, proposed', row_key FROM rows WHERE NOT changed AND proposal IS NOT NULL
  UNION ALL SELECT 'text', row_key FROM rows WHERE contains(lower(name), 'red'))
  SELECT filter, count(*) AS n, min(row_key) AS first, max(row_key) AS last FROM t GROUP BY filter""")
def filtered_rows(spark, d) -> DataFrame:
    rows = _rows(spark, d)
    folder = table(spark, d, "part").agg(F.min("p_type")).first()[0] or ""
    one = lambda label, **how: comparing.filter_rows(rows, **how).select(F.lit(label).alias("filter"), "row_key")
    every = one("folder", folders=[folder.upper()]).union(one("not same", states=["NOT_SAME"])).union(one("conflict or moved", states=["conflict", "moved"])).union(one("in b, marked", sources=["b"], marks=["keep"]))
    every = every.union(one("unchanged, proposed", changed=False, proposal=True)).union(one("text", text=" RED "))
    return every.groupBy("filter").agg(F.count("*").alias("n"), F.min("row_key").alias("first"), F.max("row_key").alias("last"))


@query(f"""WITH {_ROWS_SQL} SELECT row_key, row_state, position FROM rows ORDER BY CASE row_state WHEN 'type_conflict' THEN 0 WHEN 'missing' THEN 1 WHEN 'renamed' THEN 2 WHEN 'moved' THEN 3 WHEN 'different' THEN 4 ELSE 5 END DESC, position LIMIT 30 OFFSET 10""")
def sorted_rows(spark, d) -> DataFrame:
    """By state, the weakest first; rows of one state stay in their order."""
    return comparing.sort_rows(_rows(spark, d), "state", True).offset(10).limit(30).select("row_key", "row_state", "position")


@query(f"""WITH {_ROWS_SQL}, s AS (SELECT unnest(['type_conflict', 'missing', 'renamed', 'moved', 'different', 'same']) AS state) SELECT state, count(row_key) AS n FROM s LEFT JOIN (SELECT * FROM rows WHERE row_state <> 'moved') ON row_state = state GROUP BY state""")
def state_counts(spark, d) -> DataFrame:
    return comparing.state_counts(_rows(spark, d).where("row_state <> 'moved'"))


@query("""SELECT id, property, phrase, old, new, through_rename FROM (
  SELECT p_partkey AS id, 'expression' AS property, CASE p_partkey % 4 WHEN 1 THEN 'equal_after_rename' ELSE 'expression_changed' END AS phrase, NULL::VARCHAR AS old, NULL::VARCHAR AS new, p_partkey % 4 = 1 AS through_rename FROM part WHERE p_partkey % 4 IN (1, 2)
  UNION ALL SELECT p_partkey, 'description', 'description_changed', NULL, NULL, false FROM part WHERE p_partkey % 5 = 0
  UNION ALL SELECT p_partkey, 'hidden', 'hidden_changed', 'false', NULL, false FROM part WHERE p_partkey % 3 = 0)""")
def property_phrases(spark, d) -> DataFrame:
    """Formulas that differ in layout, in a renamed reference, or in substance; texts and values."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    one = lambda name, kind, value: F.struct(F.lit(name).alias("property"), F.lit(kind).alias("kind"), value.alias("value"))
    side = lambda dax, text, hidden: p.select(k.alias("id"), F.explode(F.array(one("expression", "dax", dax), one("description", "text", text), one("hidden", "value", hidden))).alias("x")).select("id", "x.*").where("value IS NOT NULL")
    target = side(F.lit("SUM ( Part[Size] ) // all"), F.concat("p_type", F.lit("  \r\n")), F.lit("false"))
    other = F.when(k % 4 == 1, "sum(part[Length])").when(k % 4 == 2, "SUM(Part[Weight])").otherwise("sum(part[size])")
    donor = side(other, F.when(k % 5 == 0, F.concat("p_type", F.lit(" II"))).otherwise(F.concat("p_type", F.lit("\n"))), F.when(k % 3 != 0, F.lit("false")))
    return comparing.compare_properties(target, donor, renames={"Part[Size]": "Length"})


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'name,size' ELSE 'name' END AS properties FROM part""")
def compared_properties(spark, d) -> DataFrame:
    given = F.create_map(F.lit("name"), "p_name", F.lit("x"), F.lit("1"), F.lit("table_id"), F.lit("t"), F.lit("lineage_tag"), F.lit("g"))
    more = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("size"), F.lit(" 5 "))).otherwise(F.create_map(F.lit("model_ids"), F.lit("m")))
    own = comparing.compared(F.map_concat(given, more))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.map_keys(own)), ",").alias("properties"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey, l_suppkey, l_returnflag AS e FROM lineitem) SELECT l_orderkey, l_suppkey, string_agg(e, ',' ORDER BY e) AS evidence FROM e GROUP BY 1, 2""")
def merged_evidence(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.array("l_returnflag").alias("evidence"))
    return comparing.merge_evidence(rows, ["l_orderkey", "l_suppkey"]).withColumn("evidence", F.array_join("evidence", ","))


@query("""SELECT min(p_partkey) AS first, count(*) AS copies FROM part GROUP BY p_brand, p_size""")
def distinct_records(spark, d) -> DataFrame:
    """Records with their keys in either order are one."""
    a = F.to_json(F.struct(F.struct(F.col("p_size").alias("size")).alias("shape"), F.col("p_brand").alias("brand")))
    b = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.struct(F.col("p_size").alias("size")).alias("shape")))
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, a).otherwise(b).alias("json"))
    return comparing.distinct_json(rows, "p_partkey", "json").select("first", "copies")


_SNAP_SQL = f"""{CATALOG_SQL}, x AS (SELECT id, name AS digest, coalesce(report_id, model_id) AS file FROM objects),
  y AS (SELECT id, CASE WHEN id LIKE 'measure:%4' THEN digest || ' II' ELSE digest END AS digest, file FROM x WHERE id NOT LIKE 'visual:%8'),
  f AS (SELECT DISTINCT file AS id, 'v1' AS digest FROM x), g AS (SELECT id, CASE WHEN id LIKE '%1' OR id LIKE 'report:%' THEN 'v2' ELSE digest END AS digest FROM f),
  p AS (SELECT id, status AS digest FROM links), q AS (SELECT id, CASE WHEN type = 'CONTAINS' AND to_id LIKE '%9' THEN 'approved' ELSE digest END AS digest FROM (SELECT *, status AS digest FROM links))"""


@query(f"""WITH {_SNAP_SQL}, ch AS (
  SELECT 'objects' AS level, id, CASE WHEN b.id IS NULL THEN 'DELETED' WHEN a.id IS NULL THEN 'NEW' ELSE 'CHANGED' END AS change FROM (SELECT id, digest AS u FROM x) a FULL JOIN (SELECT id, digest AS v FROM y) b USING (id) WHERE u IS DISTINCT FROM v
  UNION ALL SELECT 'files', id, 'CHANGED' FROM f JOIN g USING (id) WHERE f.digest <> g.digest
  UNION ALL SELECT 'edges', id, 'CHANGED' FROM p JOIN q USING (id) WHERE p.digest <> q.digest)
  SELECT * FROM ch UNION ALL SELECT 'unknown', id, 'UNKNOWN_DIFFERENCE' FROM ch WHERE level = 'files' AND id NOT IN (SELECT file FROM x WHERE id IN (SELECT id FROM ch WHERE level = 'objects'))""")
def compared_snapshots(spark, d) -> DataFrame:
    o, e = objects(spark, d), links(spark, d)
    x = o.select("id", F.col("name").alias("digest"), F.coalesce("report_id", "model_id").alias("file"))
    y = x.where("id NOT LIKE 'visual:%8'").withColumn("digest", F.when(F.col("id").like("measure:%4"), F.concat("digest", F.lit(" II"))).otherwise(F.col("digest")))
    files = x.select(F.col("file").alias("id")).distinct().withColumn("digest", F.lit("v1"))
    later = files.withColumn("digest", F.when(F.col("id").like("%1") | F.col("id").like("report:%"), "v2").otherwise(F.col("digest")))
    p = e.select("id", F.col("status").alias("digest"))
    q = e.select("id", F.when((F.col("type") == "CONTAINS") & F.col("to_id").like("%9"), "approved").otherwise(F.col("status")).alias("digest"))
    return comparing.compare_snapshots({"objects": x, "files": files, "edges": p}, {"objects": y, "files": later, "edges": q})


@query("""WITH a AS (SELECT 'doc/' || doc_id AS path, sha256(coalesce(text, '')) AS digest, length(coalesce(text, '')) AS size FROM documents WHERE doc_id % 9 <> 0),
  b AS (SELECT 'doc/' || doc_id AS path, sha256(coalesce(text, '') || CASE WHEN doc_id % 8 = 0 THEN '!' ELSE '' END) AS digest, length(coalesce(text, '')) + CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 7 <> 0)
  SELECT path, CASE WHEN a.digest IS NULL THEN 'NEW' WHEN b.digest IS NULL THEN 'DELETED' ELSE 'CHANGED' END AS change FROM a FULL JOIN b USING (path) WHERE a.digest IS DISTINCT FROM b.digest""")
def pending_changes(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    path, text = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit(""))
    files = lambda rows, t: rows.select(path, F.sha2(t, 256).alias("digest"), F.length(t).alias("size"))
    return comparing.pending_changes(files(docs.where("doc_id % 9 <> 0"), text), files(docs.where("doc_id % 7 <> 0"), F.when(F.col("doc_id") % 8 == 0, F.concat(text, F.lit("!"))).otherwise(text)))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '--- old' || chr(10) || '+++ new' || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || ' ' || p_name || chr(10) || '-' || p_brand || chr(10) || '+' || p_type END AS diff FROM part""")
def text_diffs(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", comparing.text_diff(F.concat_ws("\n", "p_name", "p_brand"), F.concat_ws("\n", "p_name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")))).alias("diff"))


@query(f"""WITH {CATALOG_SQL} SELECT CASE WHEN report_id IS NOT NULL OR type IN ('REPORT', 'PAGE', 'VISUAL') THEN 'report' WHEN model_id IS NOT NULL THEN 'model' ELSE 'other' END AS artifact, type, count(*) AS n FROM objects GROUP BY 1, 2""")
def artifacts(spark, d) -> DataFrame:
    return objects(spark, d).groupBy(comparing.artifact(F.col("type"), F.col("model_id"), F.col("report_id")).alias("artifact"), "type").agg(F.count("*").alias("n"))


@query(f"""WITH {CATALOG_SQL} SELECT id, type, substr(name, 1, 10) AS name, substr(sha256(lower(expression)), 1, 16) AS definition_hash FROM objects""")
def lineage_columns(spark, d) -> DataFrame:
    return comparing.lineage_view(objects(spark, d), 10).select("id", "type", "name", "definition_hash")


_RANK = "CASE type WHEN 'MODEL' THEN 0 WHEN 'REPORT' THEN 1 WHEN 'PAGE' THEN 3 WHEN 'VISUAL' THEN 5 ELSE 99 END"


@query(f"""WITH RECURSIVE {CATALOG_SQL}, s AS (SELECT id, parent_id, lpad(({_RANK})::VARCHAR, 2, '0') || ':' || lower(name) || ':' || id AS step FROM objects),
  w AS (SELECT id, step AS path FROM s WHERE parent_id IS NULL UNION ALL SELECT s.id, w.path || '>' || s.step FROM w JOIN s ON s.parent_id = w.id)
  SELECT id, path FROM w""")
def overview_order(spark, d) -> DataFrame:
    """Objects by depth first, children by type and name; sorting on the path gives the order."""
    rank = F.when(F.col("type") == "MODEL", 0).when(F.col("type") == "REPORT", 1).when(F.col("type") == "PAGE", 3).when(F.col("type") == "VISUAL", 5).otherwise(99)
    return comparing.preorder(objects(spark, d).select("id", "parent_id", rank.alias("rank"), "name")).withColumn("path", F.array_join("path", ">"))


@query("""WITH m AS (SELECT 'report:' || (c_custkey // 20) AS report_id, 'g' || (c_nationkey % 4) AS group_name, 'visual:' || c_custkey AS id FROM customer)
  SELECT a.report_id, a.group_name, a.id AS from_id, b.id AS to_id FROM m a JOIN m b ON a.report_id = b.report_id AND a.group_name = b.group_name AND a.id < b.id""")
def synced_slicers(spark, d) -> DataFrame:
    rows = table(spark, d, "customer")
    return comparing.synced_pairs(rows.select(F.concat(F.lit("report:"), F.floor(F.col("c_custkey") / 20).cast("string")).alias("report_id"), F.concat(F.lit("g"), (F.col("c_nationkey") % 4).cast("string")).alias("group_name"), F.concat(F.lit("visual:"), F.col("c_custkey").cast("string")).alias("id")))


@query(f"""WITH {CATALOG_SQL}, v AS (SELECT id, report_id, parent_id, lower(split_part(name, '#', 1)) AS x, CAST(substr(id, 8) AS BIGINT) AS k FROM objects WHERE type = 'VISUAL'),
  pg AS (SELECT id, report_id, lower(name) AS key FROM objects WHERE type = 'PAGE' UNION ALL SELECT id, report_id, lower(id) FROM objects WHERE type = 'PAGE'),
  f AS (SELECT report_id, key, min(id) AS to_id FROM pg GROUP BY 1, 2),
  asked AS (SELECT v.id AS from_id, v.report_id, v.parent_id, lower(p.name) AS key FROM v JOIN objects p ON p.type = 'PAGE' AND p.report_id = v.report_id AND CAST(regexp_extract(p.id, '([0-9]+)$', 1) AS BIGINT) = v.k % 25)
  SELECT from_id, to_id FROM asked JOIN f USING (report_id, key) WHERE to_id <> parent_id""")
def page_links(spark, d) -> DataFrame:
    """Visuals that name a page of their report as tooltip or drillthrough."""
    o = objects(spark, d)
    pages = o.where("type = 'PAGE'").select("id", "report_id", F.array("name", "id").alias("names"))
    named = o.where("type = 'PAGE'").select("report_id", F.regexp_extract("id", "([0-9]+)$", 1).cast("long").alias("n"), F.concat(F.lit(" "), F.upper("name")).alias("page_ref"))
    k = F.substring("id", 8, 20).cast("long") % 25
    visuals = o.where("type = 'VISUAL'").select("id", "report_id", "parent_id", k.alias("n")).join(named, ["report_id", "n"]).select("id", "report_id", "parent_id", "page_ref")
    return comparing.page_links(visuals, pages)
