"""A project folder written from the tables and read back; registers with ``queries``."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.lineage import cut, shared_folder
from weftgraph.plans.queries import query
from weftgraph.sources import projects
from weftgraph.sources.star import table

_PAGES = 50  #: visuals of a page file's folder, about


def _written(spark, d) -> str:
    """A model folder per region with a declaration file per nation, a report folder per segment with pages and their visuals, and a pointer to some."""
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    region, nation, customer = (table(spark, d, t) for t in ("region", "nation", "customer"))
    key, segment, page = F.col("c_custkey"), F.lower(F.col("c_mktsegment")), F.floor(F.col("c_custkey") / _PAGES)
    file = lambda df, name, body: df.select(name.alias("file"), body.alias("text"))
    home = text("model", F.col("n_regionkey"), ".SemanticModel/definition/tables/")
    shared = F.when(F.col("n_nationkey") % 4 == 0, F.lit("\nexpression Shared = 1")).otherwise("")
    segments = customer.select("c_mktsegment").distinct()
    parts = [
        file(nation, text(home, F.col("n_name"), ".tmdl"), text("table '", F.col("n_name"), "'\n\tcolumn a", shared)),
        file(segments, text(segment, ".Report/definition.pbir"), text('{"datasetReference":{"byPath":{"path":"../model', F.length("c_mktsegment") % 5, '.SemanticModel"}}}')),
        file(customer.groupBy("c_mktsegment", page.alias("page")).count(), text(segment, ".Report/definition/pages/p", F.col("page"), "/page.json"), text('{"displayName":"Page ', F.col("page"), '"}')),
        file(customer, text(segment, ".Report/definition/pages/p", page, "/visuals/v", key, "/visual.json"), text('{"name":"', F.col("c_name"), '"}')),
        file(customer.where(key % 10 == 0), text(segment, ".Report/definition/pages/p", page, "/visuals/v", key, "/mobile.json"), F.lit("{}")),
        file(region.limit(1), F.lit("main.pbip"), F.lit('{"artifacts":[{"report":{"path":"building.Report"}},{"type":"report","path":"./x/../machinery.Report"},{"model":{"path":"model1.SemanticModel"}}]}')),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    root = f"{shared_folder(spark)}/project-{uuid4().hex}"
    projects.write_files(every.repartition(16), root)
    return root


@query(f"""WITH s AS (SELECT DISTINCT lower(c_mktsegment) || '.Report' AS folder, 'model' || (length(c_mktsegment) % 5) || '.SemanticModel' AS model FROM customer),
  named AS (SELECT * FROM s WHERE folder IN ('building.Report', 'machinery.Report') AND model IN (SELECT 'model' || n_regionkey || '.SemanticModel' FROM nation)),
  o AS (SELECT lower(c_mktsegment) || '.Report' AS folder, 'visual' AS kind, 'v' || c_custkey AS id, 'p' || (c_custkey // {_PAGES}) AS parent, c_name AS name, CASE WHEN c_custkey % 10 = 0 THEN 'mobile' ELSE '' END AS parts FROM customer
    UNION ALL SELECT DISTINCT lower(c_mktsegment) || '.Report', 'page', 'p' || (c_custkey // {_PAGES}), NULL, 'Page ' || (c_custkey // {_PAGES}), '' FROM customer),
  r AS (SELECT 'model' || n_regionkey || '.SemanticModel' AS folder, min('definition/tables/' || n_name || '.tmdl') AS first, count(*) AS n FROM nation WHERE n_nationkey % 4 = 0 GROUP BY 1 HAVING count(*) > 1)
  SELECT 'report' AS what, folder, 'main.pbip' AS id, model AS parent, NULL::VARCHAR AS name, '' AS parts FROM named
  UNION ALL SELECT DISTINCT 'model', model, 'main.pbip', NULL, NULL, '' FROM (SELECT model FROM named UNION SELECT 'model1.SemanticModel')
  UNION ALL SELECT kind, folder, id, parent, name, parts FROM o
  UNION ALL SELECT 'repeated', folder, 'expression', NULL, 'Shared', first || ' ' || n FROM r""")
def project_folder(spark, d) -> DataFrame:
    """What a project consists of, its reports' objects, and what its models declare more than once."""
    files = cut(projects.project_files(spark, _written(spark, d)))
    none = F.lit(None).cast("string")
    own = projects.artifacts(files).select(F.col("kind").alias("what"), "folder", F.col("project").alias("id"), F.col("model").alias("parent"), none.alias("name"), F.lit("").alias("parts"))
    shown = projects.report_objects(files).select("kind", "folder", "id", "parent", "name", F.array_join("parts", ","))
    twice = projects.repeated_declarations(files).select(F.lit("repeated"), "folder", "kind", none, "name", F.concat(F.col("files")[0], F.lit(" "), F.col("places").cast("string")))
    return own.union(shown).union(twice)
