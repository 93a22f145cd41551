"""Links that formulas make: filters changed, relationships used, shared expressions read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.expressions import FUNCTION_CLASSES, call_references, reference_name, reference_table


def filter_links(formulas: DataFrame, columns: DataFrame, tables: DataFrame, relationships: DataFrame) -> DataFrame:
    """(from_id, to_id, type) of functions that change filters or relationships; ``to_id`` is null where none or several fit.

    ``formulas`` (id, model_id, formula), ``columns`` (id, model_id, table, name), ``tables`` (id, model_id, name) and
    ``relationships`` (id, model_id, from_column_id, to_column_id). A filter function MODIFIES_FILTER of the columns and
    tables inside it, TREATAS of those after its first argument. USERELATIONSHIP ACTIVATES_RELATIONSHIP, CROSSFILTER
    MODIFIES_RELATIONSHIP: the one whose two ends, in either order, are the columns named.
    """
    calls = formulas.select(F.col("id").alias("from_id"), "model_id", F.explode(call_references(F.col("formula"))).alias("r")).select("from_id", "model_id", "r.*")
    calls = calls.where(F.col("function").isin(FUNCTION_CLASSES["filter_context"] + FUNCTION_CLASSES["relationship"])).where("function <> 'TREATAS' OR argument > 0")
    held = F.col("ref").endswith("]")
    plain = F.regexp_replace("ref", "^'|'$", "")
    keyed = calls.withColumns({"t": F.lower(F.when(held, reference_table(F.col("ref"))).otherwise(F.replace(plain, F.lit("''"), F.lit("'")))), "k": F.when(held, F.lower(reference_name(F.col("ref"))))})
    of = columns.groupBy("model_id", F.lower("table").alias("t"), F.lower("name").alias("k")).agg(F.min("id").alias("to_id"))
    to_columns = keyed.where("k IS NOT NULL").join(of, ["model_id", "t", "k"])
    owners = tables.groupBy("model_id", F.lower("name").alias("t")).agg(F.min("id").alias("to_id"))
    to_tables = keyed.where("k IS NULL").join(owners, ["model_id", "t"])
    fields = ["from_id", "model_id", "call", "function", "to_id"]
    filters = to_columns.select(fields).union(to_tables.select(fields)).where(F.col("function").isin(FUNCTION_CLASSES["filter_context"]))
    changed = filters.select("from_id", "to_id", F.lit("MODIFIES_FILTER").alias("type")).distinct()

    pair = F.array_sort(F.collect_set("to_id"))
    asked = to_columns.where(F.col("function").isin(FUNCTION_CLASSES["relationship"])).groupBy("from_id", "model_id", "call", "function").agg(pair.alias("ends"))
    known = relationships.groupBy("model_id", F.array_sort(F.array("from_column_id", "to_column_id")).alias("ends")).agg(F.count("*").alias("n"), F.min("id").alias("to_id"))
    kind = F.when(F.col("function") == "USERELATIONSHIP", "ACTIVATES_RELATIONSHIP").otherwise("MODIFIES_RELATIONSHIP")
    used = asked.join(known, ["model_id", "ends"], "left").select("from_id", F.when(F.col("n") == 1, F.col("to_id")).alias("to_id"), kind.alias("type"))
    return changed.union(used.distinct())


def shared_links(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """(from_id, to_id): texts (id, model_id, text) that name a shared expression (id, model_id, name) of their model, not themselves.

    A name stands as a word or as ``#"any name"``; strings do not count. Words are met by an equi-join on the name.
    """
    code = F.regexp_replace("text", r'(#"(?:[^"]|"")*")|"(?:[^"]|"")*"|//[^\n]*|/\*[\s\S]*?\*/', "$1 ")
    found = F.regexp_extract_all(code, F.lit(r'#"(?:[^"]|"")*"|[\p{L}_][\p{L}\p{N}_.]*'), F.lit(0))
    plain = F.transform(found, lambda w: F.when(w.startswith("#"), F.replace(F.substring(w, F.lit(3), F.length(w) - 3), F.lit('""'), F.lit('"'))).otherwise(w))
    names = texts.select(F.col("id").alias("from_id"), "model_id", F.explode(F.array_distinct(plain)).alias("name"))
    return names.join(shared.select("model_id", "name", F.col("id").alias("to_id")), ["model_id", "name"]).where("from_id <> to_id").select("from_id", "to_id").distinct()
