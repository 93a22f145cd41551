"""Safety of changes, data sources upstream, usage facts, naming rules, meanings and decisions checked; registers with ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import profiles, review, safety, validation
from weftgraph.plans.queries import query
from weftgraph.sources.catalog import CATALOG_SQL, links, objects
from weftgraph.sources.star import table

_K = "p_partkey"
_AFTER_SQL = f"""{CATALOG_SQL}, a AS (SELECT * REPLACE (CASE WHEN type = 'MEASURE' AND id LIKE '%3' THEN name || ' II' ELSE name END AS name, CASE WHEN type = 'MEASURE' AND id LIKE '%4' THEN 'SUM(Nowhere[x]) + [no such] + [' || name || ']' ELSE expression END AS expression)
    FROM objects WHERE NOT (type = 'COLUMN' AND id LIKE '%5')),
  ch AS (SELECT coalesce(o.id, a.id) AS object_id, coalesce(a.type, o.type) AS type, CASE WHEN a.id IS NULL THEN 'deleted' WHEN o.name IS DISTINCT FROM a.name THEN 'renamed' WHEN o.expression IS DISTINCT FROM a.expression THEN 'changed' END AS change, o.name AS old_name, a.name AS name
    FROM objects o LEFT JOIN a ON a.id = o.id),
  changes AS (SELECT * FROM ch WHERE change IS NOT NULL),
  u AS (SELECT DISTINCT from_id AS user_id, to_id AS used FROM links WHERE type IN ('DEPENDS_ON', 'REFERENCES', 'USES') AND from_id IN (SELECT id FROM a)),
  br AS (SELECT user_id, used, 'uses_deleted' AS reason FROM u WHERE used IN (SELECT object_id FROM changes WHERE change = 'deleted')
    UNION ALL SELECT user_id, used, 'uses_old_name' FROM u WHERE used IN (SELECT object_id FROM changes WHERE change = 'renamed') AND user_id LIKE 'visual:%'),
  nd AS (SELECT object_id, unnest(['table', 'measure_or_column']) AS kind, unnest(['Nowhere', NULL]) AS "table", unnest([NULL, 'no such']) AS name FROM changes WHERE change = 'changed'
    UNION ALL SELECT c.object_id, 'measure_or_column', NULL, 'M' || substr(c.object_id, 9) FROM changes c WHERE change = 'renamed')"""


def _sides(spark, d):
    """Some columns go, some measures are renamed or get another formula; after that visuals no longer resolve the renamed ones."""
    o, e = objects(spark, d), links(spark, d)
    m = F.col("type") == "MEASURE"
    after = o.where("NOT (type = 'COLUMN' AND id LIKE '%5')").withColumn("name2", F.when(m & F.col("id").like("%3"), F.concat("name", F.lit(" II"))).otherwise(F.col("name")))
    formula = F.when(m & F.col("id").like("%4"), F.concat(F.lit("SUM(Nowhere[x]) + [no such] + ["), "name", F.lit("]"))).otherwise(F.col("expression"))
    after = after.withColumn("expression", formula).drop("name").withColumnRenamed("name2", "name")
    return o, e, after, e.where("type <> 'USES'")


@query(f"WITH {_AFTER_SQL} SELECT object_id, type, change, old_name, name FROM changes")
def safety_changes(spark, d) -> DataFrame:
    o, _, after, _ = _sides(spark, d)
    return safety.object_changes(o, after, ["name", "expression"])


@query(f"""WITH {_AFTER_SQL} SELECT user_id AS "user", used, reason FROM br""")
def safety_breaks(spark, d) -> DataFrame:
    o, e, after, later = _sides(spark, d)
    return safety.find_breaks(e, later, after, safety.object_changes(o, after, ["name", "expression"]))


@query(f'WITH {_AFTER_SQL} SELECT object_id, kind, "table", name FROM nd')
def safety_needs(spark, d) -> DataFrame:
    """Formulas that name a table or measure that their model lacks; renamed ones still name what never was there."""
    o, _, after, _ = _sides(spark, d)
    return safety.find_needs(after, safety.object_changes(o, after, ["name", "expression"]))


@query(f"""WITH {_AFTER_SQL} SELECT 'BREAKS' AS status, count(*) AS changes, 0 AS created, count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change = 'renamed') AS renamed, count(*) FILTER (change = 'changed') AS changed,
    (SELECT count(*) FROM br) AS breaks, (SELECT count(DISTINCT object_id) FROM nd) AS needs FROM changes""")
def safety_verdict(spark, d) -> DataFrame:
    o, e, after, later = _sides(spark, d)
    changes = safety.object_changes(o, after, ["name", "expression"])
    return safety.assess(changes, safety.find_breaks(e, later, after, changes), safety.find_needs(after, changes))


_SOURCES_SQL = """WITH q AS (SELECT 'part:' || n_nationkey AS id, 'model:' || n_regionkey AS model_id, CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE 'Server' || n_nationkey % 3 END AS place FROM nation),
  s AS (SELECT *, 'source:' || substr(sha256('sql|' || lower(trim(place))), 1, 16) AS source FROM q WHERE place IS NOT NULL)"""


def _queries(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    place = F.when(k % 4 == 3, None).when(k % 2 == 0, F.concat(F.lit(" SERVER"), (k % 3).cast("string"))).otherwise(F.concat(F.lit("server"), (k % 3).cast("string")))
    return table(spark, d, "nation").select(F.concat(F.lit("part:"), k.cast("string")).alias("id"), F.concat(F.lit("model:"), F.col("n_regionkey").cast("string")).alias("model_id"), F.lit("SQL").alias("kind"), place.alias("place"))


@query(f"{_SOURCES_SQL} SELECT source AS id, count(DISTINCT model_id) AS models, count(*) AS queries FROM s GROUP BY 1")
def outside_sources(spark, d) -> DataFrame:
    """One object per outside source, however it is spelled, and how many models and queries read it."""
    return safety.source_links(_queries(spark, d))[0].select("id", "models", "queries")


@query(f"""{_SOURCES_SQL}, r AS (SELECT 'table:' || n_nationkey AS root, source, 2 AS depth FROM nation JOIN s ON s.id = 'part:' || n_nationkey),
  c AS (SELECT 'column:' || s_suppkey AS root, source, 3 AS depth FROM supplier JOIN s ON s.id = 'part:' || s_nationkey)
  SELECT root, source, depth FROM r UNION ALL SELECT root, source, depth FROM c""")
def sources_of_columns(spark, d) -> DataFrame:
    """From columns back to their table, into its partition, to the source that it reads; not into sister columns."""
    q = _queries(spark, d)
    nodes, reads = safety.source_links(q)
    o = objects(spark, d).where("type IN ('TABLE', 'COLUMN', 'MODEL')").select("id", "type", "parent_id")
    home = F.concat(F.lit("table:"), F.substring("id", 6, 10))
    every = o.union(q.select("id", F.lit("PARTITION"), home)).union(nodes.select("id", F.lit("DATA_SOURCE"), F.lit(None).cast("string")))
    held = every.where("parent_id IS NOT NULL").select(F.lit("CONTAINS").alias("type"), F.col("parent_id").alias("from_id"), F.col("id").alias("to_id"))
    return safety.data_sources_of(every, held.union(reads.select("type", "from_id", "to_id")), o.where("type IN ('TABLE', 'COLUMN')").select("id"))


# --- usage, status, names --------------------------------------------------------------------

_USES_SQL = """u AS (SELECT DISTINCT CASE WHEN l_partkey % 7 = 0 THEN -1 - l_partkey ELSE l_partkey END AS object_id, o_orderkey AS visual_id,
    CASE WHEN l_linenumber % 4 = 0 THEN 'tooltip' WHEN l_linenumber % 4 = 3 OR l_partkey % 5 = 0 THEN 'sort' WHEN l_linenumber % 4 = 1 THEN 'value' ELSE 'slicer_field' END AS role, CASE WHEN o_orderkey % 5 = 0 THEN 'Card' ELSE 'chart' END AS visual_type,
    o_custkey AS page_id, CASE WHEN o_custkey % 3 = 0 THEN 'Tooltip' END AS page_type, o_custkey % 2 = 0 AS page_hidden FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  objects AS (SELECT p_partkey AS id FROM part UNION ALL SELECT -1 - p_partkey FROM part WHERE p_partkey % 7 = 0)"""


def _uses(spark, d) -> DataFrame:
    """Every line is a use; those of a part of some keys are of a second object in its place, so that the part has none."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.col("l_linenumber") % 4
    k = F.col("l_partkey")
    role = F.when(n == 0, "tooltip").when((n == 3) | (k % 5 == 0), "sort").when(n == 1, "value").otherwise("slicer_field")
    return lines.select(
        F.when(k % 7 == 0, -1 - k).otherwise(k).alias("object_id"), F.col("o_orderkey").alias("visual_id"), role.alias("role"), F.when(F.col("o_orderkey") % 5 == 0, "Card").otherwise("chart").alias("visual_type"),
        F.col("o_custkey").alias("page_id"), F.when(F.col("o_custkey") % 3 == 0, "Tooltip").alias("page_type"), (F.col("o_custkey") % 2 == 0).alias("page_hidden"),
    )


@query(f"WITH {_USES_SQL} SELECT object_id, role, visual_type, count(DISTINCT visual_id) AS visuals FROM u GROUP BY 1, 2, 3")
def usage_profile(spark, d) -> DataFrame:
    return profiles.usage_profile(_uses(spark, d))


@query(f"""WITH {_USES_SQL}, t AS (SELECT object_id, count(DISTINCT visual_id) AS visuals, count(DISTINCT page_id) AS pages, count(DISTINCT visual_id) FILTER (visual_type = 'Card' AND role = 'value') AS kpi, count(DISTINCT visual_id) FILTER (role = 'slicer_field') AS slicer,
    count(*) FILTER (role <> 'sort') AS shown, count(*) FILTER (role NOT IN ('sort', 'tooltip')) AS besides, count(DISTINCT page_id) FILTER (page_type IS NULL) AS plain, count(DISTINCT page_id) FILTER (NOT page_hidden) AS open FROM u GROUP BY 1),
  f AS (SELECT p_partkey AS object_id, 1 AS filters FROM part WHERE p_partkey % 14 = 0), b AS (SELECT o.id AS object_id, coalesce(visuals, 0) AS visuals, coalesce(pages, 0) AS pages, coalesce(kpi, 0) AS kpi, coalesce(slicer, 0) AS slicer, coalesce(shown, 0) AS shown, coalesce(besides, 0) AS besides,
    coalesce(plain, 0) AS plain, coalesce(open, 0) AS open, coalesce(filters, 0) AS filters FROM objects o LEFT JOIN t ON t.object_id = o.id LEFT JOIN f ON f.object_id = o.id)
  SELECT object_id, 'KPI_VALUE' AS fact, kpi AS n FROM b WHERE kpi > 0 UNION ALL SELECT object_id, 'SLICER_DIMENSION', slicer FROM b WHERE slicer > 0 UNION ALL SELECT object_id, 'ONLY_TOOLTIP', visuals FROM b WHERE visuals > 0 AND shown > 0 AND besides = 0
  UNION ALL SELECT object_id, 'ONLY_TOOLTIP_PAGES', pages FROM b WHERE visuals > 0 AND NOT (shown > 0 AND besides = 0) AND plain = 0 UNION ALL SELECT object_id, 'FORMATTING_OR_SORT_ONLY', visuals FROM b WHERE visuals > 0 AND shown = 0
  UNION ALL SELECT object_id, 'ONLY_HIDDEN_PAGES', pages FROM b WHERE visuals > 0 AND open = 0 UNION ALL SELECT object_id, 'FILTER_ONLY', filters FROM b WHERE visuals = 0 AND filters > 0 UNION ALL SELECT object_id, 'UNUSED_IN_REPORTS', 0 FROM b WHERE visuals = 0 AND filters = 0""")
def usage_facts(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    filters = p.where("p_partkey % 14 = 0").select(F.col(_K).alias("object_id"), F.lit("f").alias("filter_id"))
    objects = p.select(F.col(_K).alias("id")).union(p.where("p_partkey % 7 = 0").select(-1 - F.col(_K)))
    return profiles.usage_facts(objects, _uses(spark, d), filters)


@query("""SELECT o_custkey AS visual_id, CASE min(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 END) WHEN 1 THEN 'removed' WHEN 2 THEN 'breaks' WHEN 3 THEN 'changes' WHEN 4 THEN 'new' ELSE 'unchanged' END AS status FROM orders GROUP BY 1""")
def visual_statuses(spark, d) -> DataFrame:
    at = F.substring("o_orderpriority", 1, 1).cast("int")
    status = F.element_at(F.array(*map(F.lit, ["removed", "breaks", "changes", "new", "odd"])), at)
    return profiles.visual_status(table(spark, d, "orders").select(F.col("o_custkey").alias("visual_id"), status.alias("status")))


_NAMES_SQL = """n AS (SELECT p_partkey AS id, 'measure' AS object_type, 'Total_' || lower(p_brand[1:5]) || '_' || p_partkey AS name, CASE WHEN p_partkey % 8 = 0 THEN 'Other' ELSE 'Main' END AS folder FROM part
  UNION ALL SELECT c_custkey, 'column', CASE WHEN c_custkey % 9 = 0 THEN 'Net_sales' ELSE 'Gross Amount' END, NULL FROM customer)"""


def _names(spark, d) -> DataFrame:
    p, c = table(spark, d, "part"), table(spark, d, "customer")
    own = p.select(F.col(_K).alias("id"), F.lit("measure").alias("object_type"), F.concat(F.lit("Total_"), F.lower(F.substring("p_brand", 1, 5)), F.lit("_"), F.col(_K).cast("string")).alias("name"), F.when(F.col(_K) % 8 == 0, "Other").otherwise("Main").alias("folder"))
    return own.union(c.select("c_custkey", F.lit("column"), F.when(F.col("c_custkey") % 9 == 0, "Net_sales").otherwise("Gross Amount"), F.lit(None).cast("string")))


@query(f"""WITH {_NAMES_SQL}, t AS (SELECT object_type, count(*) AS total, count(*) FILTER (folder = 'Main') AS main, count(*) FILTER (name = 'Gross Amount') AS gross FROM n GROUP BY 1)
  SELECT object_type, 'separator' AS check, 'underscore' AS value, total AS obeying, total FROM t WHERE object_type = 'measure' UNION ALL SELECT object_type, 'prefix', 'Total_', total, total FROM t WHERE object_type = 'measure'
  UNION ALL SELECT object_type, 'folder', 'Main', main, total FROM t WHERE object_type = 'measure' UNION ALL SELECT object_type, unnest(['letter_case', 'separator', 'prefix', 'suffix']), unnest(['title', 'space', 'Gross ', ' Amount']), gross, total FROM t WHERE object_type = 'column'""")
def naming_checks(spark, d) -> DataFrame:
    return profiles.naming_rules(_names(spark, d))


@query(f"""WITH {_NAMES_SQL} SELECT id, 'folder' AS check, 'Main' AS value FROM n WHERE object_type = 'measure' AND folder <> 'Main' UNION ALL SELECT id, unnest(['letter_case', 'separator', 'prefix', 'suffix']), unnest(['title', 'space', 'Gross ', ' Amount']) FROM n WHERE object_type = 'column' AND name <> 'Gross Amount'""")
def names_against_rules(spark, d) -> DataFrame:
    names = _names(spark, d)
    return profiles.breaking_names(names, profiles.naming_rules(names))


# --- meanings, selectors, decisions ----------------------------------------------------------


@query(f"""WITH {CATALOG_SQL}, s AS (SELECT user_id AS target, event_type AS assertion, floor(value / 50)::BIGINT AS value, CASE event_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'candidate' ELSE 'rejected' END AS status FROM events),
  g AS (SELECT target, assertion, status FROM s WHERE status <> 'rejected' AND value IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT value) > 1)
  SELECT CASE status WHEN 'approved' THEN 'approved_semantic_contradiction' ELSE 'candidate_semantic_ambiguity' END AS code, CASE status WHEN 'approved' THEN 'WARNING' ELSE 'INFO' END AS severity, target::VARCHAR AS object_id, NULL::VARCHAR AS edge_id, assertion AS detail FROM g
  UNION ALL SELECT 'semantic_fact_mismatch', 'ERROR', NULL, id, NULL FROM links WHERE type = 'CONTAINS' AND to_id LIKE '%2'""")
def meaning_checks(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    status = F.when(F.col("event_id") % 3 == 0, "approved").when(F.col("event_id") % 3 == 1, "candidate").otherwise("rejected")
    told = e.select(F.col("user_id").cast("string").alias("target"), F.col("event_type").alias("assertion"), F.floor(F.col("value") / 50).alias("value"), status.alias("status"))
    odd = links(spark, d).withColumn("type", F.when((F.col("type") == "CONTAINS") & F.col("to_id").like("%2"), "CONTROLLED_BY").otherwise(F.col("type")))
    return validation.semantic_rules(told, odd)


@query("""WITH o AS (SELECT 'opt:' || p_partkey AS id, p_partkey AS k, 'sel:' || p_brand AS sel FROM part),
  l AS (SELECT 'h' || k AS id, 'HAS_OPTION' AS type, sel AS from_id, id AS to_id FROM o WHERE k % 4 <> 0 UNION ALL SELECT 'd' || k, 'DEFAULTS_TO', sel, id FROM o WHERE k % 6 = 0 UNION ALL SELECT 'x' || k, 'HAS_OPTION', id, sel FROM o WHERE k % 50 = 0)
  SELECT 'invalid_selector_link' AS code, 'ERROR' AS severity, NULL::VARCHAR AS object_id, id AS edge_id, 'HAS_OPTION' AS detail FROM l WHERE id LIKE 'x%'
  UNION ALL SELECT 'default_is_no_option', 'ERROR', NULL, 'd' || k, id FROM o WHERE k % 12 = 0 UNION ALL SELECT 'option_without_selector', 'WARNING', id, NULL, NULL FROM o WHERE k % 4 = 0""")
def selector_checks(spark, d) -> DataFrame:
    p, k = table(spark, d, "part"), F.col(_K)
    option, selector, n = F.concat(F.lit("opt:"), k.cast("string")), F.concat(F.lit("sel:"), "p_brand"), k.cast("string")
    every = p.select(option.alias("id"), F.lit("SELECTOR_OPTION").alias("type")).union(p.select(selector, F.lit("SELECTOR")).distinct())
    link = lambda where, mark, kind, a, b: p.where(where).select(F.concat(F.lit(mark), n).alias("id"), F.lit(kind).alias("type"), a.alias("from_id"), b.alias("to_id"))
    told = link(k % 4 != 0, "h", "HAS_OPTION", selector, option).union(link(k % 6 == 0, "d", "DEFAULTS_TO", selector, option)).union(link(k % 50 == 0, "x", "HAS_OPTION", option, selector))
    return validation.selector_rules(every, told)


@query("""WITH o AS (SELECT CASE WHEN event_id % 40 = 0 THEN ' ' ELSE user_id::VARCHAR END AS target, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'Model_Id' ELSE event_type END AS property, CASE WHEN event_id % 23 = 0 THEN 'maybe' ELSE 'approved' END AS status FROM events), n AS (SELECT * FROM o WHERE trim(target) <> '')
  SELECT 'override_missing_target' AS code, 'ERROR' AS severity, NULL AS object_id, NULL::VARCHAR AS edge_id, NULL AS detail FROM o WHERE trim(target) = ''
  UNION ALL SELECT 'override_missing_property', 'ERROR', target, NULL, NULL FROM n WHERE property IS NULL UNION ALL SELECT 'override_invalid_status', 'ERROR', target, NULL, NULL FROM n WHERE status = 'maybe'
  UNION ALL SELECT 'override_mutates_generated_fact', 'BLOCKING', target, NULL, NULL FROM n WHERE lower(property) = 'model_id' UNION ALL SELECT 'duplicate_override', 'WARNING', target, NULL, property FROM n GROUP BY target, property HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'stale_override', 'WARNING', target, NULL, NULL FROM n WHERE target NOT IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_custkey % 3 <> 0)""")
def override_checks(spark, d) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id")
    rows = e.select(F.when(i % 40 == 0, " ").otherwise(F.col("user_id").cast("string")).alias("target"), F.when(i % 17 == 0, None).when(i % 19 == 0, "Model_Id").otherwise(F.col("event_type")).alias("property"), F.when(i % 23 == 0, "maybe").otherwise("approved").alias("status"))
    return validation.override_rules(rows, table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("id")))


# --- review ----------------------------------------------------------------------------------

_QUEUE_SQL = f"""{CATALOG_SQL}, n AS (SELECT id, type, model_id, status, CASE WHEN id LIKE '%20' THEN 0.4 ELSE 0.9 END AS confidence, id AS k FROM objects WHERE status = 'candidate'),
  e AS (SELECT id, type, from_id, confidence FROM links WHERE status = 'candidate' AND evidence_class = 'INFERRED' AND to_id NOT IN (SELECT k FROM n)),
  o AS (SELECT 'd' || event_id AS id, 'visual:' || user_id AS target FROM events),
  q AS (SELECT id AS item_id, 'candidate' AS issue, type, id AS target_id, confidence FROM n UNION ALL SELECT id, 'inferred_link', type, from_id, confidence FROM e UNION ALL SELECT id, 'stale_override', 'OVERRIDE', target, 1.0 FROM o WHERE target NOT IN (SELECT id FROM objects)),
  queue AS (SELECT q.*, t.model_id, CASE WHEN t.type IN ('MEASURE', 'TABLE', 'MODEL') OR confidence < 0.5 THEN 'high' ELSE 'normal' END AS impact FROM q LEFT JOIN objects t ON t.id = target_id)"""


def _queue(spark, d) -> DataFrame:
    o = objects(spark, d).withColumns({"confidence": F.when(F.col("id").like("%20"), 0.4).otherwise(0.9), "candidate_key": F.col("id")})
    decisions = table(spark, d, "events").select(F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("visual:"), F.col("user_id").cast("string")).alias("target"))
    return review.queue(o, links(spark, d).withColumn("candidate_key", F.col("to_id")), decisions)


@query(f"WITH {_QUEUE_SQL} SELECT item_id, issue, type, target_id, model_id, confidence::DOUBLE AS confidence, impact FROM queue")
def review_queue(spark, d) -> DataFrame:
    """Candidate objects, inferred links not told by them, and decisions on what is gone."""
    return _queue(spark, d)


@query(f"WITH {_QUEUE_SQL} SELECT issue, impact, count(*) AS n FROM queue WHERE model_id IN ('model:1', 'model:3') AND issue IN ('candidate', 'inferred_link') AND confidence BETWEEN 0.3 AND 0.7 GROUP BY 1, 2")
def review_filtered(spark, d) -> DataFrame:
    rows = review.filtered(_queue(spark, d), models=["model:1", "model:3"], issues=["candidate", "inferred_link"], least=0.3, most=0.7)
    return rows.groupBy("issue", "impact").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT 'measure:' || p_partkey AS t, p_type AS v, 0.5 AS c FROM part UNION ALL SELECT 'measure:' || p_partkey, ' ' || lower(p_type), 0.9 FROM part WHERE p_partkey % 2 = 0)
  SELECT t AS from_id, 'concept:' || trim(regexp_replace(lower(v), '[^a-z0-9]+', '-', 'g'), '-') || '-' || substr(sha256(lower(trim(v))), 1, 8) AS to_id, 'SEMANTICALLY_MAPS_TO' AS type, max(c)::DOUBLE AS confidence, count(*) AS suggestions FROM s GROUP BY 1, 2""")
def concept_links(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    one = lambda rows, value, sure: rows.select(F.concat(F.lit("measure:"), F.col(_K).cast("string")).alias("target"), F.lit("BUSINESS_CONCEPT").alias("assertion"), value.alias("value"), F.lit(sure).alias("confidence"))
    return review.concept_links(one(p, F.col("p_type"), 0.5).union(one(p.where("p_partkey % 2 = 0"), F.concat(F.lit(" "), F.lower("p_type")), 0.9)))
