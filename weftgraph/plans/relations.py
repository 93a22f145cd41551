"""Join shapes, overrides and merges over the star-schema tables; registers with ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.keys import alnum_key, fold
from weftgraph.operators.regression import placed
from weftgraph.plans.queries import query
from weftgraph.sources.star import table


@query("""WITH o AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), n AS (SELECT s_nationkey, s_suppkey FROM supplier)
  SELECT l_orderkey, s_nationkey, count(*) AS matched, array_to_string(list_sort(list(l_suppkey)), ',') AS fields FROM o JOIN n ON l_suppkey = s_suppkey GROUP BY 1, 2 HAVING count(*) >= 2""")
def set_overlap(spark, d) -> DataFrame:
    """Sets that share two or more members, met through an equi-join of their members."""
    left = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey")).distinct()
    both = left.join(table(spark, d, "supplier").select("s_nationkey", "s_suppkey"), "s_suppkey")
    return both.groupBy("l_orderkey", "s_nationkey").agg(F.count("*").alias("matched"), F.array_join(F.array_sort(F.collect_list("s_suppkey")), ",").alias("fields")).where("matched >= 2")


@query("""SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2""")
def unordered_pairs(spark, d) -> DataFrame:
    t = lambda n: table(spark, d, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pair = [F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")]
    return rows.where("c_nationkey <> s_nationkey").groupBy(*pair).agg(F.countDistinct("o_orderkey").alias("orders"))


@query("""WITH o AS (SELECT user_id AS target, event_type AS property, count(*) AS n, count(DISTINCT floor(value)) AS v FROM events GROUP BY 1, 2)
  SELECT target, property, CASE WHEN c_custkey IS NULL OR c_custkey % 4 = 0 THEN 'stale' WHEN v > 1 THEN 'conflict' WHEN n > 1 THEN 'duplicate' ELSE 'applies' END AS state FROM o LEFT JOIN customer ON target = c_custkey""")
def override_states(spark, d) -> DataFrame:
    """Decisions whose target is gone, or of which one target and property have several."""
    own = table(spark, d, "events").groupBy(F.col("user_id").alias("target"), F.col("event_type").alias("property")).agg(F.count("*").alias("n"), F.countDistinct(F.floor("value")).alias("v"))
    there = table(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("target"), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "stale").when(F.col("v") > 1, "conflict").when(F.col("n") > 1, "duplicate").otherwise("applies")
    return own.join(there, "target", "left").select("target", "property", state.alias("state"))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY n_name) AS place, n_name AS v FROM nation), b AS (SELECT row_number() OVER (ORDER BY n_name) AS place, n_name AS v FROM nation WHERE n_nationkey <> 7)
  SELECT coalesce(a.place, b.place)::INTEGER AS place, a.v IS NOT DISTINCT FROM b.v AS same FROM a FULL JOIN b ON a.place = b.place""")
def positional_compare(spark, d) -> DataFrame:
    """Cell by cell over an explicit order."""
    ranked = lambda df, out: placed(df.select("n_name"), ["n_name"]).select(F.col("place").cast("int").alias("place"), F.col("row.n_name").alias(out))
    n = table(spark, d, "nation")
    return ranked(n, "a").join(ranked(n.where("n_nationkey <> 7"), "b"), "place", "full_outer").select("place", F.col("a").eqNullSafe(F.col("b")).alias("same"))


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 6 <> 0
  UNION ALL SELECT c_custkey, upper(c_name), 'MOVED' FROM customer WHERE c_custkey % 6 = 0
  UNION ALL SELECT c_custkey + 1000000, c_name, 'ADDED' FROM customer WHERE c_custkey % 50 = 0""")
def upsert(spark, d) -> DataFrame:
    """Old rows without a newer version, and the newer ones."""
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = old.where("c_custkey % 6 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit("MOVED").alias("c_mktsegment"))
    added = old.where("c_custkey % 50 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), "c_name", F.lit("ADDED").alias("c_mktsegment"))
    newer = new.unionByName(added)
    return old.join(newer.select("c_custkey"), "c_custkey", "left_anti").unionByName(newer)


@query(r"""WITH p AS (SELECT p_type, 'brand' AS property, p_brand AS v FROM part UNION ALL SELECT p_type, 'size', p_size::VARCHAR FROM part UNION ALL SELECT p_type, 'name', regexp_replace(lower(p_name), '[^\p{L}\p{N}]', '', 'g') FROM part)
  SELECT p_type, property, count(DISTINCT coalesce(v, '~')) AS variants FROM p GROUP BY 1, 2 HAVING count(DISTINCT coalesce(v, '~')) > 1""")
def property_variants(spark, d) -> DataFrame:
    """Properties in which the objects of a group differ, unpivoted in one pass."""
    one = lambda name, c: F.struct(F.lit(name).alias("property"), c.alias("v"))
    each = F.explode(F.array(one("brand", F.col("p_brand")), one("size", F.col("p_size").cast("string")), one("name", alnum_key(F.col("p_name")))))
    rows = table(spark, d, "part").select("p_type", each.alias("p")).select("p_type", "p.property", F.coalesce("p.v", F.lit("~")).alias("v"))
    return rows.groupBy("p_type", "property").agg(F.countDistinct("v").alias("variants")).where("variants > 1")


@query("""WITH r AS (SELECT p_partkey, p_brand AS scope, lower(p_name) AS k FROM part), t AS (SELECT p_brand AS scope, lower(p_name) AS k, count(*) AS n, min(p_partkey) AS target FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2)
  SELECT p_partkey, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN target::VARCHAR ELSE 'unresolved' END AS target FROM r LEFT JOIN t ON r.scope = t.scope AND r.k = t.k""")
def scoped_resolution(spark, d) -> DataFrame:
    """References by (scope, folded name); only a single candidate resolves."""
    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("scope"), fold(F.col("p_name")).alias("k"))
    found = rows.where("p_partkey % 3 <> 0").groupBy("scope", "k").agg(F.count("*").alias("n"), F.min("p_partkey").alias("found"))
    return rows.join(found, ["scope", "k"], "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("candidates"), F.when(F.col("n") == 1, F.col("found").cast("string")).otherwise("unresolved").alias("target"))


@query("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages)
  SELECT 'source:' || substr(sha256('web|' || host), 1, 16) AS source_id, host, count(*) AS pages, min(page_id) AS first_page FROM h WHERE host <> '' GROUP BY host""")
def data_sources(spark, d) -> DataFrame:
    """One node per outside source, by the digest of its identity, shared by all that read it."""
    hosts = table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host")).where("host <> ''")
    key = F.concat(F.lit("source:"), F.substring(F.sha2(F.concat(F.lit("web|"), F.col("host")), 256), 1, 16))
    return hosts.groupBy("host").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).select(key.alias("source_id"), "host", "pages", "first_page")


@query("""WITH e AS (SELECT user_id, event_id, json_extract_string(props, '$.k')::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
  SELECT a.user_id, a.event_id, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k > b.k THEN 'raised' WHEN a.k < b.k THEN 'lowered' ELSE 'same' END AS change FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.n = a.n - 1""")
def property_diff(spark, d) -> DataFrame:
    """A nested property against the same object's earlier state."""
    before = F.lag("k").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).withColumn("before", before)
    change = F.when(F.col("before").isNull(), "added").when(F.col("k") > F.col("before"), "raised").when(F.col("k") < F.col("before"), "lowered").otherwise("same")
    return rows.select("user_id", "event_id", change.alias("change"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY length(o_orderpriority), sha256(o_orderkey::VARCHAR)) AS k FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE k = 1""")
def shortest_record(spark, d) -> DataFrame:
    """One record per key: the shortest, ties by content digest; a partial minimum, not a sort."""
    rank = F.struct(F.length("o_orderpriority"), F.sha2(F.col("o_orderkey").cast("string"), 256))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", rank).alias("o_orderkey"))
