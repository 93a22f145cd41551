"""Formula, inference and review queries; registers with ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import expressions
from weftgraph.operators import inference, traversal
from weftgraph.plans.queries import query
from weftgraph.sources.star import FORMULA_SQL, formulas, table

# --- formulas --------------------------------------------------------------------------------

# two passes do here: no string of these formulas holds a comment mark
_REFS_SQL = rf"""{FORMULA_SQL},
  bare AS (SELECT id, model_id, name, regexp_replace(regexp_replace(formula, '"[^"]*"', ' ', 'g'), '(//|--)[^\n]*', ' ', 'g') AS code FROM formulas),
  r AS (SELECT DISTINCT id, model_id, unnest(regexp_extract_all(code, '(''[^'']+''|[A-Za-z_][A-Za-z0-9_]*)?\[[^\]]+\]')) AS ref FROM bare),
  refs AS (SELECT id, model_id, nullif(trim(split_part(ref, '[', 1), ''''), '') AS tab, rtrim(split_part(ref, '[', 2), ']') AS name FROM r),
  links AS (SELECT a.id AS from_id, coalesce(b.id, CASE WHEN a.tab IS NOT NULL THEN 'column:' || lower(a.tab) || '.' || lower(a.name) END) AS to_id, a.name,
    CASE WHEN a.tab IS NOT NULL THEN 'REFERENCES' WHEN b.id IS NOT NULL THEN 'DEPENDS_ON' ELSE 'UNRESOLVED' END AS type
    FROM refs a LEFT JOIN formulas b ON a.tab IS NULL AND a.model_id = b.model_id AND lower(a.name) = lower(b.name))"""


def formula_links(rows: DataFrame) -> DataFrame:
    """(from_id, to_id, name, type) of the references in (id, model_id, name, formula).

    ``Table[Column]`` REFERENCES a column; ``[Name]`` DEPENDS_ON the one measure of the model with that
    folded name, and is UNRESOLVED, with a null end, where the model has none or several.
    """
    refs = rows.select("id", "model_id", F.explode(expressions.references(F.col("formula"))).alias("r")).select(F.col("id").alias("from_id"), "model_id", "r.*")
    known = rows.groupBy("model_id", F.lower("name").alias("k")).agg(F.min("id").alias("target"), F.count("*").alias("n")).where("n = 1").drop("n")
    found = refs.withColumn("k", F.when(F.col("table").isNull(), F.lower("name"))).join(known, ["model_id", "k"], "left")
    column = F.when(F.col("table").isNotNull(), F.concat(F.lit("column:"), F.lower("table"), F.lit("."), F.lower("name")))
    kind = F.when(F.col("table").isNotNull(), "REFERENCES").when(F.col("target").isNotNull(), "DEPENDS_ON").otherwise("UNRESOLVED")
    return found.select("from_id", F.coalesce("target", column).alias("to_id"), "name", kind.alias("type"))


@query(f"WITH {_REFS_SQL} SELECT from_id, to_id, name, type FROM links")
def formula_dependencies(spark, d) -> DataFrame:
    return formula_links(formulas(spark, d))


@query(f"""WITH RECURSIVE {_REFS_SQL}, w AS (SELECT id AS root, id FROM formulas UNION SELECT w.root, l.to_id FROM w JOIN links l ON l.from_id = w.id AND l.type = 'DEPENDS_ON'),
  near AS (SELECT id FROM w) SELECT l.to_id AS id, count(DISTINCT l.from_id) AS users FROM links l WHERE l.type = 'REFERENCES' AND l.from_id IN (SELECT id FROM near) GROUP BY 1""")
def query_coverage(spark, d) -> DataFrame:
    """Columns behind the measures that a set of queries names, through all measures in between."""
    rows = formulas(spark, d)
    links = formula_links(rows)
    near = traversal.walk(links.where("type = 'DEPENDS_ON'").select("from_id", "to_id", "type"), rows.select("id"), None)
    own = links.where("type = 'REFERENCES'").join(near.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return own.groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("from_id").alias("users"))


@query(f"""WITH {FORMULA_SQL}, c AS (SELECT model_id, unnest(CASE CAST(substr(id, 9) AS BIGINT) % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['filter_context'] ELSE ['selector', 'conditional'] END) AS class FROM formulas)
  SELECT model_id, class, count(*) AS n FROM c GROUP BY 1, 2""")
def formula_classes(spark, d) -> DataFrame:
    return formulas(spark, d).select("model_id", F.explode(expressions.function_classes(F.col("formula"))).alias("class")).groupBy("model_id", "class").agg(F.count("*").alias("n"))


@query(f"""WITH {FORMULA_SQL}, k AS (SELECT id, name, model_id, lower(regexp_replace(replace(regexp_replace(formula, '(//|--)[^\\n]*', '', 'g'), '''', ''), '\\s+', '', 'g')) AS k FROM formulas)
  SELECT min(id) AS first_id, count(*) AS members, count(DISTINCT model_id) AS models FROM k GROUP BY k HAVING count(*) > 1""")
def same_formulas(spark, d) -> DataFrame:
    rows = formulas(spark, d).groupBy(F.sha2(expressions.formula_key(F.col("formula")), 256).alias("k"))
    return rows.agg(F.min("id").alias("first_id"), F.count("*").alias("members"), F.countDistinct("model_id").alias("models")).where("members > 1").drop("k")


@query(r"""SELECT page_id, NOT regexp_matches(html, '(?i)\b(?:INSERT|UPDATE|DELETE|ALTER|CREATE|DROP|MERGE|TRUNCATE|GRANT|REVOKE)\b') AS read_only FROM pages""")
def read_only_texts(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", expressions.read_only(F.col("html")).alias("read_only"))


# --- inference -------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, CASE WHEN list_has_any(w, ['date', 'calendar', 'time', 'period']) THEN 'date_dimension' WHEN list_has_any(w, ['customer', 'client', 'account']) THEN 'customer_dimension'
    WHEN list_has_any(w, ['product', 'item', 'sku']) THEN 'product_dimension' WHEN list_has_any(w, ['fact', 'transaction', 'invoice', 'sales', 'orders', 'order']) THEN 'fact'
    WHEN list_has_any(w, ['selector', 'switch', 'parameter', 'choice', 'option']) THEN 'selector' END AS role
  FROM (SELECT conv_id, turn, string_split_regex(lower(text), '[^a-z0-9]+') AS w FROM conversations)""")
def roles_of_texts(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", inference.role_from_text(F.col("text")).alias("role"))


@query("""WITH u AS (SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1),
  s AS (SELECT p_partkey AS id, p_brand, CASE WHEN u.id IS NULL OR s = 1 THEN 0.25 ELSE 0 END AS apart, CASE WHEN p_type LIKE 'S%' THEN 0.40 ELSE 0 END AS acts, CASE WHEN u.id IS NOT NULL THEN 0.25 ELSE 0 END AS used, CASE WHEN p_size <= 10 THEN 0.10 ELSE 0 END AS small FROM part LEFT JOIN u ON u.id = p_partkey)
  SELECT id, round(least(apart + acts + used + small, 0.99), 6)::DOUBLE AS score, array_to_string(list_filter([CASE WHEN acts > 0 THEN 'behaviour' END, CASE WHEN used > 0 THEN 'consumption' END, CASE WHEN apart > 0 THEN 'disconnected' END, CASE WHEN small > 0 THEN 'small' END], lambda x: x IS NOT NULL), ',') AS facts FROM s""")
def selector_scores(spark, d) -> DataFrame:
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    used = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.countDistinct("l_suppkey").alias("s"))
    facts = {
        "disconnected": (p.join(used.where("s > 1"), "id", "left_anti"), 0.25), "behaviour": (p.where("p_type like 'S%'"), 0.40),
        "consumption": (used, 0.25), "small": (p.where("p_size <= 10"), 0.10),
    }
    return inference.scored(p, facts).withColumn("facts", F.array_join("facts", ","))


@query("""WITH v AS (SELECT DISTINCT p_brand AS owner, p_size AS value FROM part WHERE p_brand IS NOT NULL AND p_size IS NOT NULL), f AS (SELECT owner FROM v GROUP BY owner HAVING count(*) <= 40)
  SELECT owner, value, row_number() OVER (PARTITION BY owner ORDER BY value)::INTEGER AS ordinal FROM v WHERE owner IN (SELECT owner FROM f)""")
def selector_options(spark, d) -> DataFrame:
    return inference.options(table(spark, d, "part").select(F.col("p_brand").alias("owner"), F.col("p_size").alias("value")), "owner", "value", 40)


@query("""WITH c AS (SELECT lower(p_type) AS l, p_brand AS source FROM part UNION ALL SELECT lower(c_mktsegment), 'segment' FROM customer)
  SELECT 'concept:' || trim(regexp_replace(l, '[^a-z0-9]+', '-', 'g'), '-') || '-' || substr(sha256(trim(l)), 1, 8) AS concept_id, count(*) AS members, count(DISTINCT source) AS sources FROM c GROUP BY 1""")
def shared_concepts(spark, d) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_type").alias("label"), F.col("p_brand").alias("source")).union(table(spark, d, "customer").select("c_mktsegment", F.lit("segment")))
    return inference.concepts(rows, F.col("label"))


@query("""WITH e AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'description' ELSE 'object_name' END AS s FROM labels UNION SELECT doc_id, CASE WHEN toxic = 1 THEN 'report_usage_x' ELSE 'rumour' END FROM labels),
  w AS (SELECT doc_id, s, CASE s WHEN 'description' THEN 0.96 WHEN 'object_name' THEN 0.30 WHEN 'report_usage_x' THEN 0.48 ELSE 0.15 END AS w FROM e)
  SELECT doc_id, round(1 - product(1 - w), 6) AS confidence, count(*) AS sources FROM w GROUP BY doc_id""")
def evidence_confidence(spark, d) -> DataFrame:
    own = F.explode(F.array(F.when(F.col("quality") == 1, "description").otherwise("object_name"), F.when(F.col("toxic") == 1, "report_usage_x").otherwise("rumour")))
    got = inference.confidence(table(spark, d, "labels").select("doc_id", own.alias("s")), "doc_id", "s")
    return got.select("doc_id", "confidence", F.size("sources").cast("long").alias("sources"))


@query("""SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, count(*) FILTER (turn = 0) AS first_turns, count(*) FILTER (length(text) > 200) AS long_turns FROM conversations GROUP BY role""")
def role_profile(spark, d) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.count_if(F.col("turn") == 0).alias("first_turns"), F.count_if(F.length("text") > 200).alias("long_turns"))


# --- review ----------------------------------------------------------------------------------

_QUEUE_SQL = """q AS (SELECT l.doc_id AS id, CASE WHEN quality = 1 THEN 'description' ELSE 'object_name' END AS source, CASE WHEN quality = 1 THEN 0.96 ELSE 0.30 END::DOUBLE AS confidence, lang, l.doc_id % 10 = 0 AS reopened FROM labels l LEFT JOIN documents USING (doc_id))"""


def _queue(spark, d) -> DataFrame:
    good = F.col("quality") == 1
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "left")
    return rows.select(F.col("doc_id").alias("id"), F.when(good, "description").otherwise("object_name").alias("source"), F.when(good, 0.96).otherwise(0.30).alias("confidence"), "lang", (F.col("doc_id") % 10 == 0).alias("reopened"))


@query(f"WITH {_QUEUE_SQL} SELECT source, count(*) AS n, min(confidence) AS least, max(confidence) AS most, count(DISTINCT lang) AS langs FROM q GROUP BY source")
def review_groups(spark, d) -> DataFrame:
    return _queue(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), F.countDistinct("lang").alias("langs"))


@query(f"WITH {_QUEUE_SQL} SELECT id, source, confidence FROM q WHERE lang IN ('en', 'de') ORDER BY confidence DESC, id LIMIT 25 OFFSET 5")
def review_page(spark, d) -> DataFrame:
    return _queue(spark, d).where("lang in ('en', 'de')").select("id", "source", "confidence").orderBy(F.desc("confidence"), "id").offset(5).limit(25)


@query(f"""WITH {_QUEUE_SQL} SELECT id, source = 'object_name' AS low_evidence, source IN ('object_name', 'description') AND confidence >= 0.9 AND NOT reopened AS auto_accepted FROM q""")
def review_flags(spark, d) -> DataFrame:
    low = inference.low_evidence(F.lit("x"), F.lit("y"), F.col("source"), F.array("source"), F.col("confidence"))
    return _queue(spark, d).select("id", low.alias("low_evidence"), inference.auto_accepted(F.col("source"), F.col("confidence"), F.col("reopened")).alias("auto_accepted"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'approved' ELSE o_orderstatus END AS status, CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus END AS previous FROM orders""")
def bulk_decision(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return inference.decide(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), o.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("approved").alias("status")))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 6 = 0 THEN 'OVERRIDDEN' ELSE c_mktsegment END AS segment FROM customer""")
def override_overlay(spark, d) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    over = c.where("id % 4 = 0").select("id", F.lit("name").alias("property"), F.upper("name").alias("value")).union(c.where("id % 6 = 0").select("id", F.lit("segment"), F.lit("OVERRIDDEN")))
    return inference.overlay(c, over, ["name", "segment"])


@query("""SELECT user_id AS target, event_type AS kind, count(DISTINCT floor(value / 50))::BIGINT AS "values", event_id % 2 = 0 AS approved FROM events GROUP BY 1, 2, 4 HAVING count(DISTINCT floor(value / 50)) > 1""")
def conflicting_assertions(spark, d) -> DataFrame:
    """More than one value for a target and assertion, among the approved and among the others."""
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("target"), F.col("event_type").alias("kind"), (F.col("event_id") % 2 == 0).alias("approved"))
    return rows.agg(F.countDistinct(F.floor(F.col("value") / 50)).alias("values")).where("values > 1")


@query("""WITH p AS (SELECT p_partkey AS id, 'Home' || (p_partkey % 25) AS home, 'm' || (p_partkey // 2) AS half, p_partkey % 3 AS way FROM part)
  SELECT id, 'table' AS kind, 'Sales' AS "table", NULL::VARCHAR AS name FROM p WHERE way < 2 UNION ALL SELECT id, 'table', home, NULL FROM p WHERE way < 2
  UNION ALL SELECT id, 'column', 'Sales', 'Qty' FROM p WHERE way = 1 UNION ALL SELECT id, 'measure', NULL, half FROM p WHERE way <> 1""")
def scoped_dependencies(spark, d) -> DataFrame:
    """What formulas refer to where variables bear the names of tables and measures, some of them only inside a call."""
    k = F.col("p_partkey")
    home, half = F.concat(F.lit("Home"), (k % 25).cast("string")), F.concat(F.lit("m"), F.floor(k / 2).cast("string"))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    formula = (
        F.when(k % 3 == 0, text("VAR Sales = COUNTROWS(Sales) RETURN [", half, "] + Sales + COUNTROWS(", home, ") // ", home, "[x]"))
        .when(k % 3 == 1, text("SUMX(Sales, VAR ", home, " = Sales[Qty] RETURN ", home, " * 2) + COUNTROWS(", home, ")"))
        .otherwise(text("VAR ", half, " = 1 VAR y = ", half, " RETURN [", half, "] + ", half, " + y"))
    )
    found = table(spark, d, "part").select(k.alias("id"), F.explode(expressions.scoped_references(formula)).alias("r"))
    return found.select("id", "r.kind", F.col("r.table").alias("table"), "r.name")
