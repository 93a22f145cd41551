"""Audit of how sources differ in the words they use, by DuckDB over shards of (language, term).

Tasks count the terms of their documents, DuckDB merging slice after slice, and send one row per
language, source and term. Rows are dealt by a hash of language and term, so a shard holds a
term's counts in all sources; DuckDB adds them up there and keeps the terms of enough documents.
With the totals known, the shards are run again: DuckDB sums the divergence of each pair of
sources over the terms that both have, and lists each source's strongest terms. Spark adds up
the shards' sums and merges their lists.

Most terms occur in few of the sources. A source that lacks a term has the same probability for
all that it lacks, so their part of a pair's sum follows from how often each count occurs in the
other source; shards join only the sources that have a term.

Results are whole numbers, so the order of adding does not matter: per group of language and
source p = 1 + floor(scale * (count + 1) / (all counts + kept terms)), and the divergence from
a group or language with q in its place is the sum of floor((p - q)^2 / q).

Defined cases: null text, language and source count as empty; a group without terms has pairs;
a language without kept terms has value 0 for all pairs; repeated rows are documents of their own
and ids are not read; whole texts are read; an empty table gives an empty result; further columns
are ignored. Of two equal values the item earlier in UTF-8 order ranks first.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.scratch import forget, give_back, stage
from weftgraph.llm.tokens import Words, kinds, slices, text_of

LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Bytes of text for each shard, at least.
SHARD_BYTES = 64 << 20
#: Rows that DuckDB holds before it merges or passes them on.
HELD_ROWS = 1_500_000
#: Parts in which a group's strongest terms are ranked before all parts are.
RANK_PARTS = 32
#: Bytes that are no part of a term: all below 0x80 but letters.
TERMS = kinds(bytes(b for b in range(128) if not chr(b).isalpha()))
COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, source string, term string, n long, lang_n long, first int"
SUMS = "part string, lang string, source string, item string, n long, value decimal(38,0)"


def _engine() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1})
    _do(con, "SET memory_limit = '600MB'")
    _do(con, "SET temp_directory = ''")  # nothing goes to a machine's own disk
    return con


def _do(con: duckdb.DuckDBPyConnection, sql: str) -> list[tuple]:
    """Runs ``sql`` to its end."""
    return con.execute(sql).fetchall()


def _batches(con: duckdb.DuckDBPyConnection, sql: str) -> Iterator[pa.RecordBatch]:
    yield from con.sql(sql).to_arrow_table().to_batches(max_chunksize=50_000)


MERGED = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL"


class _Held:
    """Counts in a DuckDB table, merged whenever it has grown by ``HELD_ROWS``."""

    def __init__(self, con: duckdb.DuckDBPyConnection):
        self.con, self.rows = con, 0
        _do(con, "CREATE TABLE held(lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")

    def add(self, sql: str, **tables: pa.Table) -> int:
        for name, table in tables.items():
            self.con.register(name, table)
        _do(self.con, f"INSERT INTO held {sql}")
        for name in tables:
            self.con.unregister(name)
        return self.size()

    def merge(self) -> int:
        for sql in (f"CREATE OR REPLACE TABLE merged AS {MERGED}", "DROP TABLE held", "ALTER TABLE merged RENAME TO held"):
            _do(self.con, sql)
        return self.size()

    def size(self) -> int:
        return _do(self.con, "SELECT count(*) FROM held")[0][0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns lang, source, text in; counts of these rows out, per slice and merged over slices."""
    forget()
    con = _engine()
    held = _Held(con)
    for some in slices(batches, 2):
        words = Words(some.column(2), TERMS)
        terms = pa.table({"row": pa.array(words.row), "term": pa.DictionaryArray.from_arrays(pa.array(words.code), text_of(words.distinct))})
        rows = pa.table({"row": pa.array(np.arange(len(some), dtype=np.int32)), "lang": some.column(0), "source": some.column(1)})
        del words
        size = held.add("SELECT lang, source, term, sum(n), count(*) FROM (SELECT row, term, count(*) AS n FROM terms GROUP BY row, term) JOIN rows USING (row) GROUP BY ALL", terms=terms, rows=rows)
        if size > HELD_ROWS:
            yield from _batches(con, MERGED)
            _do(con, "DELETE FROM held")
    yield from _batches(con, MERGED)
    con.close()
    give_back()


def _collected(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.Table]:
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(map(len, some)) >= most:
            yield pa.Table.from_batches(some)
            some = []
    if some:
        yield pa.Table.from_batches(some)


def _keeper(least_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        con = _engine()
        held, base = _Held(con), 0
        for some in _collected(batches):
            rows = held.add("SELECT * FROM given", given=some)
            if rows > base + HELD_ROWS:
                base = held.merge()
        held.merge()
        yield from _batches(
            con,
            f"""SELECT lang, source, term, n, (sum(n) OVER t)::BIGINT AS lang_n, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::INTEGER AS first
            FROM held WINDOW t AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER t >= {least_docs}""",
        )
        con.close()
        give_back()

    return run


def _summer(scale: int, top: int):
    p = lambda n, all_n: f"(1 + ({n} + 1)::HUGEINT * {scale} // ({all_n} + terms))::BIGINT"
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q}) // {q})"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        con = _engine()
        _do(con, "CREATE TABLE c(lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, p BIGINT, p0 BIGINT, q BIGINT)")
        for some in _collected(batches):
            con.register("given", some)
            _do(con, f"INSERT INTO c SELECT lang, source, term, n, {p('n', 'source_n')}, {p('0', 'source_n')}, {p('lang_n', 'all_n')} FROM given")
            con.unregister("given")
        both = f"{f('a.p', 'b.p')} - {f('a.p', 'b.p0')} - {f('a.p0', 'b.p')} + {f('a.p0', 'b.p0')}"
        for sql in (
            f"SELECT 'pair', a.lang, a.source, b.source, NULL::BIGINT, sum({both}) FROM c a JOIN c b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source",
            "SELECT 'count', lang, source, NULL::VARCHAR, n, count(*) FROM c GROUP BY lang, source, n",
            f"""SELECT 'term', lang, source, term, NULL::BIGINT, {f("p", "q")} FROM c WHERE p > q
            QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {f("p", "q")} DESC, term) <= {top}""",
        ):
            yield from _batches(con, f"SELECT part, lang, source, item, n, value::DECIMAL(38,0) AS value FROM ({sql}) AS x(part, lang, source, item, n, value)")
        con.close()
        give_back()

    return run


def _p(n: Column, all_n: Column, terms: Column, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / (all_n + terms)); null where both are 0."""
    wide = (n + 1).cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.when(all_n + terms > 0, F.call_function("div", wide, (all_n + terms).cast("decimal(20,0)")) + 1)


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q).cast("decimal(19,0)")


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, scale: int = SCALE, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows per other source, ``term`` rows for the strongest terms."""
    spark = docs.sparkSession
    clean = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    groups = stage(clean.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes")), "divergence-groups")
    text_bytes = groups.agg(F.sum("bytes")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // shard_bytes), 1)
    kept = stage(clean.mapInArrow(_count, COUNTS).repartition(shards, "lang", "term").mapInArrow(_keeper(least_docs), KEPT), "divergence-terms")

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n"), F.sum("first").alias("terms"))
    langs = sums.groupBy("lang").agg(F.sum("source_n").alias("all_n"), F.sum("terms").alias("terms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    totals = stage(groups.select("lang", "source").join(sums.drop("terms"), ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("source_n"), zero("all_n"), zero("terms")), "divergence-totals")

    shard_rows = kept.select("lang", "source", "term", "n", "lang_n").join(totals, ["lang", "source"])
    parts = stage(shard_rows.repartition(shards, "lang", "term").mapInArrow(_summer(scale, top), SUMS), "divergence-sums")

    own = totals.select("lang", "source", "source_n", "terms", _p(F.lit(0), F.col("source_n"), F.col("terms"), scale).alias("p0"))
    other = own.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    told = lambda df, value: df.select("lang", "source", "item", value.cast("decimal(38,0)").alias("value"))
    pairs = own.join(other, "lang").where("source <> item")
    none_has_it = told(pairs, F.coalesce(_f(F.col("p0"), F.col("q0")) * F.col("terms").cast("decimal(18,0)"), F.lit(0)))
    counts = parts.where("part = 'count'").groupBy("lang", "source", "n").agg(F.sum("value").cast("decimal(18,0)").alias("times"))
    one_has_it = counts.join(own, ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("source_n"), F.col("terms"), scale)).join(other, "lang").where("source <> item")
    there = F.struct("source", "item", ((_f(F.col("p"), F.col("q0")) - _f(F.col("p0"), F.col("q0"))) * F.col("times")).cast("decimal(38,0)").alias("value"))
    back = F.struct(F.col("item").alias("source"), F.col("source").alias("item"), ((_f(F.col("q0"), F.col("p")) - _f(F.col("q0"), F.col("p0"))) * F.col("times")).cast("decimal(38,0)").alias("value"))
    one_has_it = one_has_it.select("lang", F.explode(F.array(there, back)).alias("x")).select("lang", "x.*")
    both_have_it = told(parts.where("part = 'pair'"), F.col("value"))
    summed = none_has_it.unionByName(one_has_it).unionByName(both_have_it).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    order = [F.desc("value"), F.col("item")]
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    in_part = F.row_number().over(Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(RANK_PARTS))).orderBy(*order))
    terms = parts.where("part = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"))
    best = terms.withColumn("rank", in_part).where(F.col("rank") <= top).withColumn("rank", ranked).where(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(summed.withColumn("rank", ranked), "pair").unionByName(columns(best, "term"))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
size AS (SELECT lang, count(*) AS v, sum(n) AS all_n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS group_n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.group_n, 0) + z.v))::BIGINT AS p,
    (1 + 1000000000::HUGEINT * (k.n + 1) // (z.all_n + z.v))::BIGINT AS q
  FROM groups g JOIN size z USING (lang) JOIN kept k USING (lang) LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
diff AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN diff x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL SELECT lang, source, part, item, value, rank::INTEGER FROM ranked WHERE rank <= 200
"""
