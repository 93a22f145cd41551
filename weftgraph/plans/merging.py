"""Merge queries: many sources, compare rows, offers, needs, names, rewriting, bindings; registers with ``queries``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import align, merge
from weftgraph.plans.queries import query
from weftgraph.sources import folders
from weftgraph.sources.star import FORMULA_SQL, formulas, table


def _three(spark, d) -> DataFrame:
    """Three sources of tables (brands) and columns (parts): ``b`` renames its tables, ``b`` and ``c`` share columns that ``a`` lacks."""
    p, k, none = table(spark, d, "part"), F.col("p_partkey"), F.lit(None).cast("string")
    named, part_id = F.concat("p_name", F.lit(" "), k.cast("string")), F.concat(F.lit("c"), k.cast("string"))
    column = lambda s, where, home, name: p.where(where).select(F.lit(s).alias("source"), part_id.alias("id"), F.lit("COLUMN").alias("kind"), none.alias("tag"), home.alias("table"), name.alias("name"))
    brands = p.select("p_brand").distinct()
    holder = lambda s, name: brands.select(F.lit(s).alias("source"), F.concat(F.lit("t"), "p_brand").alias("id"), F.lit("TABLE").alias("kind"), F.concat(F.lit("tag"), "p_brand").alias("tag"), none.alias("table"), name.alias("name"))
    new = F.concat(F.lit("New "), "p_brand")
    return reduce(DataFrame.union, [
        holder("a", F.col("p_brand")), holder("b", new), holder("c", F.col("p_brand")), column("a", k % 3 != 0, F.col("p_brand"), named), column("b", k % 2 == 0, new, named), column("c", k % 5 != 0, F.col("p_brand"), F.upper(named)),
    ])


@query("""WITH t AS (SELECT DISTINCT 't' || p_brand AS id FROM part)
  SELECT 'a:' || id AS row_key, source, id, CASE WHEN source <> 'a' THEN 'tag' END AS step FROM t, (SELECT unnest(['a', 'b', 'c']) AS source)
  UNION ALL SELECT 'a:c' || p_partkey, 'a', 'c' || p_partkey, NULL FROM part WHERE p_partkey % 3 <> 0
  UNION ALL SELECT CASE WHEN p_partkey % 3 <> 0 THEN 'a' ELSE 'b' END || ':c' || p_partkey, 'b', 'c' || p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'key' END FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT CASE WHEN p_partkey % 3 <> 0 THEN 'a' WHEN p_partkey % 2 = 0 THEN 'b' ELSE 'c' END || ':c' || p_partkey, 'c', 'c' || p_partkey, CASE WHEN p_partkey % 3 <> 0 OR p_partkey % 2 = 0 THEN 'key' END FROM part WHERE p_partkey % 5 <> 0""")
def aligned_sources(spark, d) -> DataFrame:
    return merge.align_many(_three(spark, d), ["a", "b", "c"])


_CELLS_SQL = """l AS (SELECT l_orderkey, 's' || l_linenumber AS source, CASE l_quantity::INT % 6 WHEN 0 THEN 'renamed' WHEN 1 THEN 'moved' WHEN 2 THEN 'different' ELSE 'same' END AS state FROM lineitem WHERE l_linenumber <= 4)"""


def _cells(spark, d) -> DataFrame:
    q = F.col("l_quantity").cast("int") % 6
    state = F.when(q == 0, "renamed").when(q == 1, "moved").when(q == 2, "different").otherwise("same")
    return table(spark, d, "lineitem").where("l_linenumber <= 4").select(F.col("l_orderkey").alias("row_key"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("source"), state.alias("state"))


@query(f"""WITH {_CELLS_SQL},
  g AS (SELECT l_orderkey, min(CASE state WHEN 'renamed' THEN 3 WHEN 'moved' THEN 4 WHEN 'different' THEN 5 ELSE 6 END) AS r, count(*) AS present, count(*) FILTER (source = 's1') AS own, count(*) FILTER (state <> 'same') AS unlike FROM l GROUP BY 1)
  SELECT l_orderkey AS row_key, CASE WHEN present < 4 THEN 'missing' ELSE ['type_conflict', 'missing', 'renamed', 'moved', 'different', 'same'][r] END AS row_state, present, own = 0 AND present > 1 AND unlike > 0 AS donor_conflict FROM g""")
def compare_rows(spark, d) -> DataFrame:
    return merge.compare_rows(_cells(spark, d), "s1", 4)


@query("""SELECT 'web' AS source, event_id AS id, event_type AS mark, CASE WHEN c_custkey IS NOT NULL THEN 'row:' || c_custkey END AS row_key FROM events LEFT JOIN customer ON event_id = c_custkey AND c_custkey % 4 <> 0""")
def marks(spark, d) -> DataFrame:
    """Marks on compare rows; those on objects that are gone are orphans."""
    placed = table(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.lit("web").alias("source"), F.col("c_custkey").alias("id"), F.concat(F.lit("row:"), F.col("c_custkey").cast("string")).alias("row_key"))
    return merge.marked(placed, table(spark, d, "events").select(F.lit("web").alias("source"), F.col("event_id").alias("id"), F.col("event_type").alias("mark")))


@query("""WITH u AS (SELECT DISTINCT o_orderpriority AS source, 'p' || o_custkey AS page, 'v' || o_orderkey AS visual, 'Part[P' || l_partkey || ']' AS f, CASE WHEN l_partkey % 10 = 0 THEN 1 WHEN l_partkey % 10 < 7 THEN 0 ELSE -1 END AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
  v AS (SELECT source, page, visual, list_sort(coalesce(list(f) FILTER (n = 1), [])) AS r, list_sort(coalesce(list(f) FILTER (n = -1), [])) AS m FROM u GROUP BY 1, 2, 3), p AS (SELECT source, page, list_sort(coalesce(list(DISTINCT f) FILTER (n = 1), [])) AS r FROM u GROUP BY 1, 2)
  SELECT source, 'visual' AS kind, visual AS name, page, array_to_string(r, ',') AS refs, array_to_string(m, ',') AS missing FROM v WHERE len(r) > 0 UNION ALL SELECT source, 'page', page, NULL, array_to_string(r, ','), '' FROM p WHERE len(r) > 0""")
def carry_over_offers(spark, d) -> DataFrame:
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")  # noqa: E741
    text = lambda at, c: F.concat(F.lit(at), F.col(c).cast("string"))
    fields = o.join(l, o["o_orderkey"] == l["l_orderkey"]).select(F.col("o_orderpriority").alias("source"), text("p", "o_custkey").alias("page"), text("v", "o_orderkey").alias("visual"), F.lit("Part").alias("entity"), text("P", "l_partkey").alias("property"))
    p, k = table(spark, d, "part"), F.col("p_partkey")
    got = merge.offers(fields, p.where(k % 10 == 0).select(text("part/p", "p_partkey").alias("name")), p.where((k % 10 > 0) & (k % 10 < 7)).select(text("P", "p_partkey").alias("name")))
    return got.select("source", "kind", "name", "page", F.array_join("references", ",").alias("refs"), F.array_join("missing_fields", ",").alias("missing"))


@query("""WITH n AS (SELECT DISTINCT l_orderkey AS step, l_partkey AS item FROM lineitem)
  SELECT step, item, CASE WHEN item % 9 = 0 THEN 'blocked' WHEN item % 2 = 0 THEN 'exists' WHEN item % 5 = 0 THEN 'mapped' WHEN item % 7 = 0 THEN 'clash' WHEN item % 3 = 0 THEN 'missing' ELSE 'add' END AS outcome,
    coalesce((CASE WHEN item % 9 = 0 THEN NULL WHEN item % 2 = 0 THEN item WHEN item % 5 = 0 THEN item - 1 WHEN item % 7 = 0 THEN NULL WHEN item % 3 = 0 THEN NULL ELSE item END)::VARCHAR, 'none') AS target FROM n""")
def settled_needs(spark, d) -> DataFrame:
    """What steps need: the even parts are there, of the others some are mapped, offered, or share a name with one that is."""
    k, p = F.col("item"), table(spark, d, "part").select(F.col("p_partkey").alias("item"))
    name = lambda c: F.concat(F.lit("Part "), c.cast("string"))
    kept = p.where(k % 2 == 0).select("item", name(k).alias("name"))
    donors = p.where(~((k % 3 == 0) & (k % 7 != 0))).select("item", F.when(k % 7 == 0, "PART 2").otherwise(name(k)).alias("name"))
    needs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("step"), F.col("l_partkey").alias("item")).distinct()
    got = merge.settle_needs(needs, kept, p.where(k % 9 == 0), p.where((k % 5 == 0) & (k % 2 == 1)).select("item", (k - 1).alias("target")), donors)
    return got.withColumn("target", F.coalesce(F.col("target").cast("string"), F.lit("none")))


@query("""WITH o AS (SELECT p_partkey AS id, p_brand, p_name AS name, 'sel_' || replace(lower(p_name), ' ', '_') AS core FROM part WHERE p_partkey % 3 <> 0),
  t AS (SELECT p_brand, 'sel_' || replace(lower(p_name), ' ', '_') AS core, 1 AS used FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL),
  n AS (SELECT id, name, core, row_number() OVER (PARTITION BY p_brand, core ORDER BY id) + coalesce(used, 0) AS n FROM o LEFT JOIN t USING (p_brand, core))
  SELECT id, name, CASE WHEN n > 1 THEN core || ' (' || n || ')' ELSE core END AS proposed, n > 1 AS clash FROM n""")
def proposed_names(spark, d) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey")
    taken = p.where(k % 3 == 0).select(F.concat(F.lit("Sel_"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("name"), "p_brand")
    return merge.propose_names(p.where(k % 3 != 0).select(k.alias("id"), F.col("p_name").alias("name"), "p_brand"), taken, ["p_brand"], "snake", prefix="sel_")


@query(f"""WITH {FORMULA_SQL} SELECT id, formula, CASE split_part(id, ':', 2)::BIGINT % 4
    WHEN 0 THEN 'SUM(''All parts''[size])'
    WHEN 1 THEN replace(replace(formula, 'Part[brand]', '''All parts''[maker]'), '[M' || (split_part(id, ':', 2)::BIGINT - 1) || '],', '[Sum ' || (split_part(id, ':', 2)::BIGINT - 1) || '],')
    WHEN 2 THEN replace(formula, 'Part[type]', '''All parts''[type]')
    ELSE replace(replace(formula, 'Part[brand]', '''All parts''[maker]'), '', '') END AS new_formula,
    [1, 2, 1, 1][split_part(id, ':', 2)::BIGINT % 4 + 1] AS changed FROM formulas""")
def rewritten_formulas(spark, d) -> DataFrame:
    """Measures after a table, one of its columns and some measures are renamed, in both models."""
    f = formulas(spark, d).select("id", F.col("model_id").alias("scope"), "name", "formula")
    number = F.substring_index("id", ":", -1)
    models = f.select("scope").distinct()
    row = lambda df, t, n, new_t, new_n: df.select("scope", *[(F.lit(v).cast("string") if v is None or isinstance(v, str) else v).alias(c) for c, v in zip(("table", "name", "new_table", "new_name"), (t, n, new_t, new_n), strict=True)])
    measures = f.where(number.cast("long") % 4 == 0)
    renames = row(models, "part", None, "All parts", None).union(row(models, "PART", "brand", "All parts", "maker")).union(row(measures, None, F.col("name"), None, F.concat(F.lit("Sum "), number)))
    return merge.rewrite(f, renames)


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS v FROM orders GROUP BY 1) SELECT 'EXPECTED_VALUE' AS mode, true AS passed, count(*) AS compared, 0 AS failed, 0 AS missing_rows, 0 AS new_rows FROM a
  UNION ALL SELECT 'EXPECTED_CHANGE', false, count(*), count(*) FILTER (v > 3), 0, 0 FROM a UNION ALL SELECT 'EXPECTED_VALUE', false, count(*), 0, 0, 0 FROM a""")
def expected_results(spark, d) -> DataFrame:
    """Results held against explicit expected ones: met, missed, and none given."""
    after = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").cast("double").alias("v"))
    half = after.withColumn("v", F.col("v") / 2)
    one = lambda mode, **kw: align.verdict(half, after, mode, ["k"], ["v"], **kw)
    return one("EXPECTED_VALUE", expected=after).union(one("EXPECTED_CHANGE", expected=after.withColumn("v", F.least("v", F.lit(3.0))), how="NUMERIC_TOLERANCE")).union(align.verdict(after, after, "EXPECTED_VALUE", ["k"], ["v"]))


@query("""SELECT p_partkey AS id, 'COLUMN' AS kind, p_brand AS entity, 'Size' AS property, NULL AS aggregate, CASE WHEN p_partkey % 5 = 0 THEN 'slicer_field' ELSE 'value' END AS role FROM part
  UNION ALL SELECT p_partkey, 'MEASURE', 'Sales', 'Total', NULL, 'legend' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'COLUMN', 'Sales', 'Price', ['Sum', 'Avg', 'Count'][p_partkey % 3 + 1], NULL FROM part""")
def visual_bindings(spark, d) -> DataFrame:
    """Fields of visuals whose query is a JSON string: alias, kind, aggregate and role."""
    k = F.col("p_partkey")
    config = F.format_string(
        '{"singleVisual":{"visualType":"%s","projections":{"Values":[{"queryRef":"x"}]%s},"prototypeQuery":{"From":[{"Name":"p","Entity":"%s"},{"Name":"s","Entity":"Sales"}],"Select":['
        '{"Column":{"Expression":{"SourceRef":{"Source":"p"}},"Property":"Size"},"Name":"x"}%s,{"Aggregation":{"Expression":{"Column":{"Expression":{"SourceRef":{"Source":"s"}},"Property":"Price"}},"Function":%d},"Name":"z"}]}}}',
        F.when(k % 5 == 0, "listSlicer").otherwise("barChart"), F.when(k % 2 == 0, ',"Series":[{"queryRef":"y"}]').otherwise(""), F.col("p_brand"),
        F.when(k % 2 == 0, ',{"Measure":{"Expression":{"SourceRef":{"Entity":"Sales"}},"Property":"Total"},"Name":"y"}').otherwise(""), k % 3,
    )
    return folders.visual_bindings(table(spark, d, "part").select(k.alias("id"), config.alias("config")))


@query("""SELECT DISTINCT trim(unnest(string_split(p_type || '; ' || p_brand || ';', ';'))) AS folder FROM part WHERE p_type IS NOT NULL EXCEPT SELECT ''""")
def display_folders(spark, d) -> DataFrame:
    return folders.display_folders(table(spark, d, "part").select(F.concat("p_type", F.lit("; "), "p_brand", F.lit(";")).alias("display_folder")))


@query("""SELECT p_partkey AS id, 'COLUMN' AS kind, 'Home' || (p_partkey % 25) AS entity, p_name AS property, NULL::VARCHAR AS level FROM part
  UNION ALL SELECT p_partkey, 'MEASURE', NULL, 'M' || p_partkey, NULL FROM part WHERE p_partkey % 5 > 0
  UNION ALL SELECT p_partkey, 'COLUMN', 'Inner', p_brand, NULL FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, 'HIERARCHY', 'Home' || (p_partkey % 25), 'H', 'L' || (p_partkey % 7) FROM part WHERE p_partkey % 4 = 0""")
def nested_fields(spark, d) -> DataFrame:
    """Fields inside sums of up to five levels, in a subquery that hides an alias, and a level that orders."""
    k, p = F.col("p_partkey"), table(spark, d, "part")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    column = lambda name: text('{"Column":{"Expression":{"SourceRef":{"Source":"a"}},"Property":"', name, '"}}')
    deep = (k % 5).cast("int")
    left, right = F.expr("repeat('{\"Arithmetic\":{\"Left\":', cast(p_partkey % 5 as int))"), text(',"Right":{"Measure":{"Property":"[M', k, ']"}}}}')
    summed = text('{"Aggregation":{"Expression":', left, column(F.col("p_name")), F.array_join(F.array_repeat(right, deep), ""), ',"Function":0}}')
    inner = F.when(k % 3 == 0, text(',"Where":[{"In":{"Query":{"From":[{"Name":"a","Entity":"Inner"}],"Select":[', column(F.col("p_brand")), "]}}}]")).otherwise("")
    order = F.when(k % 4 == 0, text(',"OrderBy":[{"Expression":{"HierarchyLevel":{"Expression":{"Hierarchy":{"Expression":{"SourceRef":{"Source":"a"}},"Hierarchy":"H"}},"Level":"L', k % 7, '"}}}]')).otherwise("")
    config = text('{"query":{"From":[{"Name":"a","Entity":"Home', k % 25, '"}],"Select":[', summed, "]", inner, order, "}}")
    return folders.nested_bindings(p.select(k.alias("id"), config.alias("config")))
