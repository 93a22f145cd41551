"""A change plan compiled end to end over measures of a target and a donor; registers with ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import compiling
from weftgraph.operators.walks import DROPPED, MAPPED
from weftgraph.plans.queries import query
from weftgraph.sources.star import table

# The target lacks every fifth measure; every measure needs the one of half its key. The donor calls every 35th as the target calls the next one.
_SQL = """m AS (SELECT p_partkey AS k, p_partkey // 2 AS n FROM part),
  live0 AS (SELECT k FROM m WHERE k % 5 <> 0),
  removed AS (SELECT k, CASE WHEN k % 80 = 21 THEN 'cascade' ELSE 'block' END AS policy FROM live0 WHERE k % 40 = 21),
  chosen AS (SELECT k FROM m WHERE k % 40 IN (0, 7, 11)),
  deleted AS (SELECT k, policy FROM removed UNION SELECT m.k, d.policy FROM deleted d JOIN m ON m.n = d.k AND d.policy = 'cascade' WHERE m.k % 5 <> 0 AND m.k NOT IN (SELECT k FROM chosen) AND m.k > 1),
  gone AS (SELECT DISTINCT k FROM deleted),
  live AS (SELECT k FROM live0 WHERE k NOT IN (SELECT k FROM gone)),
  renamed AS (SELECT k FROM live WHERE k % 40 = 11),
  begun AS (SELECT k, CASE WHEN k IN (SELECT k FROM live) THEN 'REPLACE' ELSE 'CREATE' END AS op FROM m WHERE k % 40 IN (0, 7) AND k > 0),
  judged AS (SELECT m.k, CASE WHEN n IN (SELECT k FROM gone) THEN 'removed' WHEN n IN (SELECT k FROM live) OR n IN (SELECT k FROM begun) THEN 'exists' WHEN n % 13 = 0 THEN 'dropped'
    WHEN n % 9 = 0 AND n + 1 IN (SELECT k FROM live) THEN 'mapped' WHEN n % 40 = 5 THEN 'missing' WHEN n % 35 = 0 AND n + 1 IN (SELECT k FROM live) AND n + 1 NOT IN (SELECT k FROM renamed) THEN 'clash' ELSE 'add' END AS outcome, n FROM m WHERE k > 1),
  items AS (SELECT k FROM begun UNION SELECT j.n FROM items i JOIN judged j ON j.k = i.k AND j.outcome = 'add'),
  needs AS (SELECT j.* FROM items JOIN judged j USING (k)),
  out AS (SELECT k FROM needs WHERE outcome = 'dropped'),
  made AS (SELECT k, coalesce(op, 'CREATE') AS op FROM items LEFT JOIN begun USING (k) WHERE k NOT IN (SELECT k FROM out)),
  standing AS (SELECT * FROM needs WHERE k NOT IN (SELECT k FROM out)),
  touched AS (SELECT m.k, m.n, m.k % 3 <> 0 AS agreed FROM m JOIN renamed r ON r.k = m.n WHERE m.k > 1 AND m.k IN (SELECT k FROM live) AND m.k NOT IN (SELECT k FROM begun)),
  donor_name AS (SELECT k, 'm' || CASE WHEN k % 35 = 0 THEN k + 1 ELSE k END AS name FROM m),
  final AS (SELECT k, CASE WHEN k IN (SELECT k FROM renamed) THEN 'r' || k ELSE 'm' || k END AS name FROM live UNION ALL SELECT i.k, d.name FROM items i JOIN donor_name d USING (k) WHERE i.k NOT IN (SELECT k FROM live)),
  ops AS (
    SELECT 'DELETE' AS op, 0 AS phase, k, NULL::VARCHAR AS text FROM gone UNION ALL SELECT 'RENAME', 1, k, 'r' || k FROM renamed
    UNION ALL SELECT a.op, CASE a.op WHEN 'CREATE' THEN 2 ELSE 3 END, a.k, 'SUM([' || coalesce(f.name, d.name, '') || '])' FROM made a LEFT JOIN standing s ON s.k = a.k LEFT JOIN m ON m.k = a.k LEFT JOIN donor_name d ON d.k = m.n
      LEFT JOIN final f ON f.k = CASE s.outcome WHEN 'mapped' THEN s.n + 1 ELSE s.n END
    UNION ALL SELECT 'REWRITE_EXPRESSION', 4, k, 'SUM([r' || n || '])' FROM touched WHERE agreed),
  edge AS (SELECT a.k AS f, b.k AS t, a.phase FROM ops a JOIN m ON m.k = a.k AND m.k > 1 JOIN ops b ON b.k = m.n AND b.phase = a.phase WHERE a.phase = 0
    UNION ALL SELECT b.k, a.k, a.phase FROM ops a JOIN standing s ON s.k = a.k JOIN ops b ON b.k = CASE s.outcome WHEN 'mapped' THEN s.n + 1 ELSE s.n END AND b.phase = a.phase WHERE a.op IN ('CREATE', 'REPLACE')),
  way AS (SELECT phase, k, 0 AS layer FROM ops UNION SELECT w.phase, e.t, w.layer + 1 FROM way w JOIN edge e ON e.f = w.k AND e.phase = w.phase),
  placed AS (SELECT phase, k, max(layer) AS layer FROM way GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_SQL}
  SELECT 'operation' AS kind, row_number() OVER (ORDER BY phase, layer, 'row:' || k) AS place, op AS what, 'row:' || k AS object_id, NULL::VARCHAR AS cause, text FROM ops JOIN placed USING (phase, k)
  UNION ALL SELECT 'blocking', 0, 'removal_blocked', 'row:' || m.k, 'row:' || d.k, NULL FROM (SELECT k FROM gone WHERE k IN (SELECT k FROM removed WHERE policy = 'block')) d JOIN m ON m.n = d.k AND m.k > 1
    WHERE m.k IN (SELECT k FROM live) AND m.k NOT IN (SELECT k FROM chosen)
  UNION ALL SELECT CASE outcome WHEN 'add' THEN 'warning' ELSE 'blocking' END, 0, CASE outcome WHEN 'add' THEN 'need_added' WHEN 'removed' THEN 'removed' ELSE 'need_' || outcome END, 'row:' || k, 'row:' || n, NULL FROM standing WHERE outcome IN ('add', 'removed', 'missing', 'clash')
  UNION ALL SELECT 'blocking', 0, 'renamed', 'row:' || k, 'row:' || n, NULL FROM touched WHERE NOT agreed
  UNION ALL SELECT 'blocking', 0, 'no_source_object', 'row:0', NULL, NULL""")
def compiled_plan(spark, d) -> DataFrame:
    """Choices over the measures of two models, with needs that run on, names that clash, removals and renames."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    row = lambda c: F.concat(F.lit("row:"), c.cast("string"))
    name = lambda c: F.concat(F.lit("m"), c.cast("string"))
    half, none = F.floor(k / 2), F.lit(None).cast("string")
    donor = lambda c: name(F.when(c % 35 == 0, c + 1).otherwise(c))
    formula = lambda c: F.concat(F.lit("SUM(["), c, F.lit("])"))
    cells = p.where(k % 5 != 0).select(F.lit("a").alias("source"), row(k).alias("row_key"), name(k).alias("name"), none.alias("table"), formula(name(half)).alias("formula"))
    cells = cells.union(p.where(k > 0).select(F.lit("b"), row(k), donor(k), none, formula(donor(half))))
    links = p.where(k > 1).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("source"), row(k).alias("from_row"), row(half).alias("to_row"))
    at = k % 40
    choice = F.when(at.isin(0, 7), "take").when(at == 11, "edit").when((at == 21) & (k % 5 != 0), "remove").when(at == 5, "keep")
    choices = p.select(row(k).alias("row_key"), choice.alias("choice"), F.when(at.isin(0, 7), "b").alias("source_id"), F.when(at == 11, F.concat(F.lit("r"), k.cast("string"))).alias("new_name"),
                       F.array().cast("array<string>").alias("properties"), F.when(k % 80 == 21, "cascade").alias("policy"), none.alias("repoint")).where("choice IS NOT NULL")
    said = p.where((k % 13 == 0) | (k % 9 == 0)).select(row(k).alias("row_key"), F.when(k % 13 == 0, DROPPED).otherwise(MAPPED).alias("action"), row(k + 1).alias("target_row"))
    included = p.where(k % 3 != 0).select(row(k).alias("row_key"), row(half).alias("cause"))
    plan = compiling.compile_plan(p.select(row(k).alias("row_key"), F.lit("measure").alias("object_type")), cells, links, choices, "a", said, included)
    return plan.withColumn("place", F.coalesce("place", F.lit(0)))
