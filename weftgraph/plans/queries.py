"""Every query with the SQL that it is held against: name -> (builder, SQL)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.keys import alnum_key, edge_id, lexical, name_style, noisy_or
from weftgraph.functions.lineage import shared_folder
from weftgraph.operators import compare, search, text_index, traversal
from weftgraph.sources.star import GRAPH_SQL, edges, nodes, table

REGISTRY: dict[str, tuple] = {}


def query(sql: str):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


# --- graph -----------------------------------------------------------------------------------


@query(f"WITH {GRAPH_SQL} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def type_counts(spark, d) -> DataFrame:
    return nodes(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""WITH {GRAPH_SQL} SELECT id, type, name FROM nodes WHERE id IN (
  SELECT to_id FROM edges WHERE from_id = 'nation:3' UNION SELECT from_id FROM edges WHERE to_id = 'nation:3')""")
def neighbours(spark, d) -> DataFrame:
    return traversal.neighbours(edges(spark, d), nodes(spark, d), "nation:3").select("id", "type", "name")


@query(f"""WITH {GRAPH_SQL}, ends AS (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges),
  counted AS (SELECT id, count(*) AS degree FROM ends GROUP BY id)
  SELECT id, type, degree FROM counted JOIN nodes USING (id) ORDER BY degree DESC, id LIMIT 5""")
def hot_objects(spark, d) -> DataFrame:
    ends = edges(spark, d).select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return ends.join(nodes(spark, d), "id").select("id", "type", "degree").orderBy(F.desc("degree"), "id").limit(5)


IMPACT_SQL = f"""WITH RECURSIVE {GRAPH_SQL},
  w AS (
    SELECT to_id AS id, 0 AS depth, false AS stopped FROM edges WHERE from_id = 'nation:3' AND type = 'CONTAINS'
    UNION
    SELECT e.from_id, w.depth + 1, e.type = 'USES' FROM w JOIN edges e ON e.to_id = w.id
    WHERE NOT w.stopped AND w.depth < 5 AND e.type IN ('DEPENDS_ON', 'REFERENCES', 'USES')),
  least AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)
"""


def _impact(spark, d) -> DataFrame:
    every = edges(spark, d)
    seeds = every.where("from_id = 'nation:3' and type = 'CONTAINS'").select(F.col("to_id").alias("id"))
    back = every.where("type in ('DEPENDS_ON', 'REFERENCES', 'USES')").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "type")
    return traversal.walk(back, seeds, 5, ("USES",))


@query(IMPACT_SQL + "SELECT type, depth::INTEGER AS depth, count(*) AS n FROM least JOIN nodes USING (id) GROUP BY type, depth")
def nation_impact(spark, d) -> DataFrame:
    return _impact(spark, d).join(nodes(spark, d), "id").groupBy("type", "depth").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, c AS (SELECT * FROM edges WHERE type = 'CONTAINS'),
  both_ways AS (SELECT from_id, to_id FROM c UNION ALL SELECT to_id, from_id FROM c),
  w AS (SELECT 'supplier:1' AS id, 0 AS depth UNION SELECT b.to_id, depth + 1 FROM w JOIN both_ways b ON b.from_id = w.id WHERE depth < 3),
  near AS (SELECT DISTINCT id FROM w)
  SELECT from_id, to_id, type FROM c WHERE from_id IN (SELECT id FROM near) AND to_id IN (SELECT id FROM near)""")
def khop_slice(spark, d) -> DataFrame:
    own = edges(spark, d).where("type = 'CONTAINS'")
    near = traversal.walk(traversal.either_way(own), spark.createDataFrame([("supplier:1",)], "id string"), 3)
    return traversal.induced(own, near).select("from_id", "to_id", "type")


@query(f"""WITH RECURSIVE {GRAPH_SQL},
  w AS (SELECT 'region:1' AS id, 0 AS depth UNION SELECT e.to_id, depth + 1 FROM w JOIN edges e ON e.from_id = w.id WHERE depth < 4),
  f AS (SELECT id, min(depth) AS depth FROM w GROUP BY id),
  back AS (SELECT id, depth FROM f WHERE id = (SELECT min('customer:' || c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)
    UNION ALL SELECT * FROM (SELECT min(f.id) AS id, f.depth FROM back JOIN edges e ON e.to_id = back.id JOIN f ON f.id = e.from_id AND f.depth = back.depth - 1 GROUP BY f.depth))
  SELECT depth::INTEGER AS step, id FROM back WHERE id IS NOT NULL""")
def shortest_path(spark, d) -> DataFrame:
    goal = nodes(spark, d).where("type = 'CUSTOMER' and model_id = 'region:1'").agg(F.min("id")).first()[0]
    return traversal.shortest_path(edges(spark, d), "region:1", goal)


@query(f"""WITH RECURSIVE {GRAPH_SQL},
  w AS (SELECT id FROM nodes WHERE type = 'ORDER' UNION SELECT e.to_id FROM w JOIN edges e ON e.from_id = w.id)
  SELECT type, count(*) AS reached FROM w JOIN nodes USING (id) GROUP BY type""")
def closure(spark, d) -> DataFrame:
    seeds = nodes(spark, d).where("type = 'ORDER'").select("id")
    return traversal.walk(edges(spark, d), seeds, None).join(nodes(spark, d), "id").groupBy("type").agg(F.count("*").alias("reached"))


TRADE_SQL = """trade AS (
  SELECT c_nationkey AS f, s_nationkey AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2 HAVING sum(l_extendedprice) > (
    SELECT 1.15 * avg(v) FROM (SELECT sum(l_extendedprice) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY c_nationkey, s_nationkey)))"""


@query(f"""WITH RECURSIVE {TRADE_SQL},
  reach AS (SELECT f, t FROM trade UNION SELECT r.f, e.t FROM reach r JOIN trade e ON r.t = e.f),
  looped AS (SELECT f AS n FROM reach WHERE f = t),
  behind AS (SELECT n FROM looped UNION SELECT t FROM reach WHERE f IN (SELECT n FROM looped))
  SELECT 'nation:' || n_nationkey AS id, n_nationkey IN (SELECT n FROM behind) AS behind_cycle FROM nation""")
def cycle_check(spark, d) -> DataFrame:
    t = lambda n: table(spark, d, n)
    sums = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("c_nationkey", "s_nationkey").agg(F.sum("l_extendedprice").alias("v"))
    )
    mean = sums.agg(F.avg("v")).first()[0] or 0.0
    key = lambda c: F.concat(F.lit("nation:"), F.col(c).cast("string"))
    trade = sums.where((F.col("c_nationkey") != F.col("s_nationkey")) & (F.col("v") > 1.15 * mean)).select(key("c_nationkey").alias("from_id"), key("s_nationkey").alias("to_id"))
    every = t("nation").select(key("n_nationkey").alias("id"))
    _, left = traversal.layers(trade, every)
    return every.join(left.withColumn("behind", F.lit(True)), "id", "left").select("id", F.coalesce("behind", F.lit(False)).alias("behind_cycle"))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, e AS (SELECT * FROM edges WHERE type IN ('CONTAINS', 'DEPENDS_ON', 'REFERENCES')),
  w AS (SELECT id, 0 AS layer FROM nodes UNION SELECT e.to_id, layer + 1 FROM w JOIN e ON e.from_id = w.id)
  SELECT layer::INTEGER AS layer, count(*) AS n FROM (SELECT id, max(layer) AS layer FROM w GROUP BY id) GROUP BY layer""")
def topological_layers(spark, d) -> DataFrame:
    order, _ = traversal.layers(edges(spark, d).where("type in ('CONTAINS', 'DEPENDS_ON', 'REFERENCES')"), nodes(spark, d))
    return order.groupBy("layer").agg(F.count("*").alias("n"))


@query(f"""WITH {GRAPH_SQL}, kept AS (SELECT id FROM nodes WHERE type <> 'PART' OR id NOT LIKE '%7')
  SELECT DISTINCT 'from' AS "end", from_id AS id FROM edges WHERE from_id NOT IN (SELECT id FROM kept)
  UNION ALL SELECT DISTINCT 'to', to_id FROM edges WHERE to_id NOT IN (SELECT id FROM kept)""")
def dangling_ends(spark, d) -> DataFrame:
    kept = nodes(spark, d).where("type <> 'PART' or id not like '%7'")
    return traversal.dangling(edges(spark, d), kept).select("end", "id")


@query(f"""WITH {GRAPH_SQL} SELECT id, type FROM nodes n WHERE type IN ('CUSTOMER', 'SUPPLIER') AND NOT EXISTS (
  SELECT 1 FROM edges e JOIN nodes p ON p.id = e.from_id WHERE e.type = 'CONTAINS' AND e.to_id = n.id AND p.type = 'NATION' AND p.id <> 'nation:5')""")
def orphan_objects(spark, d) -> DataFrame:
    return traversal.orphans(edges(spark, d).where("from_id <> 'nation:5'"), nodes(spark, d), {"CUSTOMER": "NATION", "SUPPLIER": "NATION"})


@query(f"""WITH {GRAPH_SQL} SELECT 'edge:' || substr(sha256(type || '|' || from_id || '|' || to_id), 1, 32) AS edge_id, type FROM edges WHERE type = 'CONTAINS'""")
def edge_identities(spark, d) -> DataFrame:
    return edges(spark, d).where("type = 'CONTAINS'").select(edge_id(F.col("type"), F.col("from_id"), F.col("to_id")).alias("edge_id"), "type")


# --- changes, alignment, results -------------------------------------------------------------

NEW_ORDERS = "o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority"


@query(f"""WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 0),
  b AS (SELECT {NEW_ORDERS} FROM orders WHERE o_orderkey % 11 <> 0)
  SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'NEW' WHEN b.o_orderkey IS NULL THEN 'DELETED'
    WHEN a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority = b.o_orderpriority THEN 'UNCHANGED' ELSE 'CHANGED' END AS status
  FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def change_classes(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    new = o.where("o_orderkey % 11 <> 0").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus", "o_orderpriority")
    return compare.classify(o.where("o_orderkey % 10 <> 0"), new, "o_orderkey", ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "status")


@query("""WITH a AS (SELECT * FROM part WHERE p_partkey % 9 <> 0),
  b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' II' ELSE p_name END AS p_name, p_brand, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 8 <> 0)
  SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'CREATED' WHEN b.p_partkey IS NULL THEN 'DELETED'
    WHEN a.p_name <> b.p_name THEN 'RENAMED' WHEN a.p_size <> b.p_size OR a.p_brand <> b.p_brand THEN 'CHANGED' ELSE 'SAME' END AS status
  FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""")
def renames(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    new = p.where("p_partkey % 8 <> 0").withColumn("p_name", F.expr("CASE WHEN p_partkey % 5 = 0 THEN p_name || ' II' ELSE p_name END")).withColumn("p_size", F.expr("CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END"))
    return compare.with_renames(p.where("p_partkey % 9 <> 0"), new, "p_partkey", "p_name", ["p_brand", "p_size"])


@query("""WITH c AS (SELECT c_custkey AS id, c_nationkey AS n, floor(c_acctbal / 250)::BIGINT AS b FROM customer), s AS (SELECT s_suppkey AS id, s_nationkey AS n, floor(s_acctbal / 250)::BIGINT AS b FROM supplier),
  one AS (SELECT x.id AS left_id, y.id AS right_id, 'nation and balance' AS step FROM (SELECT min(id) AS id, n, b FROM c GROUP BY n, b HAVING count(*) = 1) x JOIN (SELECT min(id) AS id, n, b FROM s GROUP BY n, b HAVING count(*) = 1) y USING (n, b)),
  c2 AS (SELECT * FROM c WHERE id NOT IN (SELECT left_id FROM one)), s2 AS (SELECT * FROM s WHERE id NOT IN (SELECT right_id FROM one)),
  two AS (SELECT x.id AS left_id, y.id AS right_id, 'balance' AS step FROM (SELECT min(id) AS id, b FROM c2 GROUP BY b HAVING count(*) = 1) x JOIN (SELECT min(id) AS id, b FROM s2 GROUP BY b HAVING count(*) = 1) y USING (b))
  SELECT * FROM one UNION ALL SELECT * FROM two""")
def cascading_match(spark, d) -> DataFrame:
    balance = lambda c: F.floor(F.col(c) / 250)
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"), balance("c_acctbal").alias("b"))
    right = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("n"), balance("s_acctbal").alias("b"))
    return compare.cascade(left, right, {"nation and balance": [F.col("n"), F.col("b")], "balance": [F.col("b")]})


@query(r"""WITH o AS (SELECT p_type AS kind, regexp_replace(lower(p_name), '[^\p{L}\p{N}]', '', 'g') AS name_key, p_brand AS source, p_size::VARCHAR AS signature FROM part),
  r AS (SELECT kind, name_key, count(DISTINCT source) AS sources, count(DISTINCT signature) AS variants, min(signature) AS signature FROM o GROUP BY kind, name_key),
  alone AS (SELECT r.kind, r.signature, o.source FROM r JOIN (SELECT DISTINCT kind, name_key, source FROM o) o USING (kind, name_key) WHERE sources = 1 AND variants = 1),
  moved AS (SELECT kind, signature FROM alone GROUP BY kind, signature HAVING count(*) > 1 AND count(*) = count(DISTINCT source))
  SELECT r.kind, r.name_key, r.sources, r.variants, CASE WHEN sources = 1 AND m.kind IS NOT NULL THEN 'renamed' WHEN sources = 1 THEN 'unique' WHEN variants = 1 THEN 'identical' ELSE 'differs' END AS bucket
  FROM r LEFT JOIN moved m ON m.kind = r.kind AND m.signature = r.signature""")
def commonality_buckets(spark, d) -> DataFrame:
    return compare.commonality(table(spark, d, "part").select(F.col("p_type").alias("kind"), alnum_key(F.col("p_name")).alias("name_key"), F.col("p_brand").alias("source"), F.col("p_size").cast("string").alias("signature")))


@query("""WITH a AS (SELECT l_returnflag AS flag, l_linestatus AS status FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber >= 2)
  SELECT flag, status, sum(n)::BIGINT AS surplus FROM (SELECT flag, status, 1 AS n FROM a UNION ALL SELECT l_returnflag, l_linestatus, -1 FROM b) GROUP BY flag, status HAVING sum(n) <> 0""")
def bag_surplus(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_linenumber")
    return compare.bag_difference(rows.where("l_linenumber <= 3").drop("l_linenumber"), rows.where("l_linenumber >= 2").drop("l_linenumber"))


@query("""WITH a AS (SELECT o_custkey AS k, count(*)::DOUBLE AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*)::DOUBLE AS v FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL OR b.k IS NULL THEN 'missing' WHEN abs(a.v - b.v) <= greatest(1.0, 0.1 * greatest(abs(a.v), abs(b.v))) THEN 'passed' ELSE 'failed' END AS verdict FROM a FULL JOIN b ON a.k = b.k""")
def tolerance_check(spark, d) -> DataFrame:
    count = lambda where: table(spark, d, "orders").where(where).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").cast("double").alias("v"))
    judged = compare.compare_results(count("o_orderkey % 3 <> 0"), count("o_orderkey % 4 <> 0"), ["k"], ["v"], "NUMERIC_TOLERANCE", 1.0, 0.1)
    return judged.select("k", F.when(F.col("passed").isNull(), "missing").when(F.col("passed"), "passed").otherwise("failed").alias("verdict"))


# --- aggregates, windows, pages --------------------------------------------------------------


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
  SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS together FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 3""")
def co_occurrence(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    pairs = rows.withColumnRenamed("l_suppkey", "a").join(rows.withColumnRenamed("l_suppkey", "b"), "l_orderkey").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("together")).where("together >= 3")


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def cross_tab(spark, d) -> DataFrame:
    states = ["F", "O", "P"]
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in states])


@query("""SELECT 'segment' AS facet, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'nation', c_nationkey::VARCHAR, count(*) FROM customer GROUP BY 2""")
def facets(spark, d) -> DataFrame:
    each = F.explode(F.array(F.struct(F.lit("segment").alias("facet"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("nation").alias("facet"), F.col("c_nationkey").cast("string").alias("value"))))
    return table(spark, d, "customer").select(each.alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT d.source, CASE WHEN quality = 1 THEN 0.86 ELSE 0.30 END AS w FROM labels l JOIN documents d USING (doc_id)),
  p AS (SELECT source, count(*) AS n, round(1 - product(1 - w), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY source, w ORDER BY w) AS k FROM w) WHERE k = 1 GROUP BY source)
  SELECT source, n, confidence FROM p""")
def confidence(spark, d) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select("source", F.when(F.col("quality") == 1, 0.86).otherwise(0.30).alias("w"))
    return rows.groupBy("source").agg(F.array_sort(F.collect_set("w")).alias("ws")).select("source", F.size("ws").cast("long").alias("n"), noisy_or(F.col("ws")).alias("confidence"))


@query(r"""WITH n AS (SELECT doc_id, source, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g')) AS signature FROM documents)
  SELECT min(doc_id) AS first_id, count(*) AS members, count(DISTINCT source) AS sources FROM n GROUP BY signature HAVING count(*) > 1 AND count(DISTINCT source) > 1""")
def duplicate_logic(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", F.xxhash64(lexical(F.coalesce("text", F.lit("")))).alias("h"), F.sha2(lexical(F.coalesce("text", F.lit(""))), 256).alias("signature"))
    return rows.groupBy("h", "signature").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("members"), F.countDistinct("source").alias("sources")).where("members > 1 and sources > 1").select("first_id", "members", "sources")


@query("""WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, event_id) AS k FROM events)
  SELECT user_id, event_type, event_id FROM r WHERE k = 1""")
def highest_state(spark, d) -> DataFrame:
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 1).otherwise(2)
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by(F.struct("event_type", "event_id"), F.struct(rank, F.col("event_id"))).alias("e")).select("user_id", "e.event_type", "e.event_id")


@query("""SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE 'candidate' END AS status FROM orders GROUP BY o_custkey""")
def unanimous_status(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.when(F.countDistinct("o_orderstatus") == 1, F.min("o_orderstatus")).otherwise("candidate").alias("status"))


@query("""WITH r AS (SELECT conv_id, turn, length(text) AS size, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS so_far FROM conversations)
  SELECT conv_id, count(*) AS turns, max(so_far)::BIGINT AS size FROM r WHERE so_far <= 2000 GROUP BY conv_id""")
def budget_page(spark, d) -> DataFrame:
    running = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, d, "conversations").withColumn("so_far", F.sum(F.length("text")).over(running))
    return rows.where("so_far <= 2000").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("so_far").alias("size"))


@query("""SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40""")
def ranked_page(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").offset(40).limit(20)


# --- search, naming, validation --------------------------------------------------------------

_LEX = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def _ladder_sql(field: str, q: str, weight: int) -> str:
    v, words = _LEX.format(field), ", ".join(f"'{w}'" for w in sorted(set(q.split())))
    return f"CASE WHEN {v} = '{q}' THEN {weight} WHEN starts_with({v}, '{q}') THEN {weight - 60} WHEN contains(' ' || {v} || ' ', ' {q} ') THEN {weight - 90} WHEN list_has_all(string_split({v}, ' '), [{words}]) THEN {weight - 120} END"


@query(f"""WITH {GRAPH_SQL}, s AS (SELECT id, type, name, greatest({_ladder_sql("id", "customer 000000001", 1000)}, {_ladder_sql("name", "customer 000000001", 920)})::INTEGER AS score FROM nodes)
  SELECT * FROM s WHERE score IS NOT NULL""")
def ranked_search(spark, d) -> DataFrame:
    return search.ranked(nodes(spark, d), "customer 000000001", ("id", "name"))


_INDEXES: dict[tuple, text_index.Index] = {}


def stored_index(spark, d, stemmed: bool = False) -> text_index.Index:
    """The index of the documents' texts, built once for an application."""
    key = (spark.sparkContext.applicationId, d, stemmed)
    if key not in _INDEXES:
        _INDEXES[key] = text_index.build(table(spark, d, "documents"), f"{shared_folder(spark)}/index-{uuid4().hex}", "doc_id", "text", stemmed)
    return _INDEXES[key]


@query(f"""WITH s AS (SELECT doc_id AS id, list_filter(string_split({_LEX.format("coalesce(text, '')")}, ' '), lambda w: w <> '') AS words FROM documents),
  c AS (SELECT id, len(words) AS size, len(list_filter(words, lambda w: w = 'token')) AS n0, len(list_filter(words, lambda w: w = 'the')) AS n1 FROM s),
  t AS (SELECT count(*) AS docs, avg(size) AS mean, count(*) FILTER (n0 > 0) AS d0, count(*) FILTER (n1 > 0) AS d1 FROM c)
  SELECT id, round(ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * n0 * 2.2 / (n0 + 1.2 * (0.25 + 0.75 * size / mean)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * n1 * 2.2 / (n1 + 1.2 * (0.25 + 0.75 * size / mean)), 6) AS score
  FROM c, t WHERE n0 > 0 OR n1 > 0""")
def bm25_search(spark, d) -> DataFrame:
    return text_index.search(spark, stored_index(spark, d), ["token", "the"], prefix=False, every=False)


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[\x09-\x0D ]+', ' ', 'g')) AS t FROM documents WHERE strpos(lower(text), 'token') > 0),
  p AS (SELECT doc_id, t, greatest(least(greatest(strpos(lower(t), 'token') - 81, 0), length(t) - 240), 0) AS s FROM f)
  SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || substr(t, s + 1, 240) || CASE WHEN s + 240 < length(t) THEN '…' ELSE '' END END AS excerpt FROM p""")
def excerpts(spark, d) -> DataFrame:
    return table(spark, d, "documents").where(F.instr(F.lower("text"), "token") > 0).select("doc_id", search.excerpt(F.col("text"), "token").alias("excerpt"))


_STYLE_SQL = """CASE WHEN regexp_matches(x, '^[A-Z][a-z0-9]*( [A-Z0-9][a-z0-9]*)+$') THEN 'title' WHEN regexp_matches(x, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake' WHEN regexp_matches(x, '^[A-Z0-9]+([ _#][A-Z0-9]+)*$') THEN 'upper'
  WHEN regexp_matches(x, '^[a-z0-9]+( [a-z0-9]+)*$') THEN 'lower' WHEN regexp_matches(x, '^[A-Z][A-Za-z0-9]*$') THEN 'pascal' WHEN regexp_matches(x, '^[a-z][A-Za-z0-9]*$') THEN 'camel' ELSE 'other' END"""


@query(f"""WITH n AS (SELECT 'part' AS kind, p_name AS x FROM part UNION ALL SELECT 'type', p_type FROM part UNION ALL SELECT 'brand', p_brand FROM part UNION ALL SELECT 'segment', c_mktsegment FROM customer UNION ALL SELECT 'event', event_type FROM events),
  s AS (SELECT kind, {_STYLE_SQL} AS style FROM n), c AS (SELECT kind, style, count(*) AS obeying, sum(count(*)) OVER (PARTITION BY kind)::BIGINT AS total FROM s GROUP BY kind, style)
  SELECT kind, style, obeying, total FROM c WHERE total >= 5 AND obeying * 1000 >= 800 * total""")
def naming_rules(spark, d) -> DataFrame:
    t = lambda n, c, kind: table(spark, d, n).select(F.lit(kind).alias("kind"), F.col(c).alias("x"))
    names = t("part", "p_name", "part").union(t("part", "p_type", "type")).union(t("part", "p_brand", "brand")).union(t("customer", "c_mktsegment", "segment")).union(t("events", "event_type", "event"))
    counts = names.groupBy("kind", name_style(F.col("x")).alias("style")).agg(F.count("*").alias("obeying"))
    return counts.withColumn("total", F.sum("obeying").over(Window.partitionBy("kind"))).where("total >= 5 and obeying * 1000 >= 800 * total")


@query(f"""WITH {GRAPH_SQL}
  SELECT 'SELF_LOOP' AS code, from_id AS object_id FROM edges WHERE from_id = to_id
  UNION ALL SELECT 'DUPLICATE_EDGE', from_id FROM edges GROUP BY from_id, to_id, type HAVING count(*) > 1
  UNION ALL SELECT 'UNUSED_PART', id FROM nodes n WHERE type = 'PART' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.to_id = n.id)
  UNION ALL SELECT 'DUPLICATE_NAME', min(id) FROM nodes WHERE type <> 'ORDER' GROUP BY type, lower(name) HAVING count(*) > 1""")
def integrity_issues(spark, d) -> DataFrame:
    e, n = edges(spark, d), nodes(spark, d)
    issue = lambda code, df, c: df.select(F.lit(code).alias("code"), F.col(c).alias("object_id"))
    return (
        issue("SELF_LOOP", e.where("from_id = to_id"), "from_id")
        .union(issue("DUPLICATE_EDGE", e.groupBy("from_id", "to_id", "type").count().where("count > 1"), "from_id"))
        .union(issue("UNUSED_PART", n.where("type = 'PART'").join(e.select(F.col("to_id").alias("id")), "id", "left_anti"), "id"))
        .union(issue("DUPLICATE_NAME", n.where("type <> 'ORDER'").groupBy("type", F.lower("name")).agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1"), "id"))
    )
