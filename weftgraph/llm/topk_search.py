"""Exact top-k search by inner product with the threshold algorithm.

Vectors become integers, floor(1024 x). Candidates are dealt to blocks of bounded size, each
to one block only; per block each dimension has its list of candidates by value, made once.
A task holds one block at a time and reads the queries past it, batch by batch. For a query
the lists are read from the end that its component favours; newly met candidates are scored,
and reading stops once the sum of the values last read, each times its component, cannot
beat the k-th best score. That score is known from the start: one block is searched first,
and what it yields bounds the others from below. Blocks' answers merge by a window per query;
neither side is broadcast or gathered.

Defined cases: vectors that are null or empty, or hold a null or a non-finite component,
take no part; vectors of different lengths are not compared; rows are told apart by number,
so rows that repeat an id are candidates of their own (for each other too), and each query
row has its own ranks; a null id is a candidate but no query; ties go to the smaller id, a
null id last; components and scores beyond 64 bits count as the nearest 64-bit number; with
fewer than k candidates all are returned; empty tables give an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.scratch import give_back, stage

K = 10
SCALE = 1024
#: Components that a block of candidates holds.
BLOCK_NUMBERS = 1 << 20
FIRST_STEP = 16
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
FOUND = "query_row long, query_id long, vec_id long, score long"


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))  # floor stops at 64 bits


def usable(vector: Column) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, odd)


class Lists:
    """A block's candidates in order of id (null last) and, per dimension, their order by value."""

    def __init__(self, rows: list, ids: list, vectors: np.ndarray):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, rows[i]))
        self.rows, self.ids = np.array([rows[i] for i in order], np.int64), [ids[i] for i in order]
        self.vectors = vectors[order]
        self.rising = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.vectors, self.rising, axis=0)
        self.most = max(abs(int(self.vectors.max(initial=0))), abs(int(self.vectors.min(initial=0))))
        self.floats = self.vectors.astype(np.float64)

    def scores(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        bound = self._bound(query)
        if bound < 2**53:
            return (self.floats[places] @ query.astype(np.float64)).astype(np.int64)
        if bound < 2**63:
            return self.vectors[places] @ query
        exact = (sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in self.vectors[places])
        return np.array([min(max(x, _LEAST), _MOST) for x in exact], np.int64)

    def _bound(self, query: np.ndarray) -> int:
        return max(abs(int(query.max(initial=0))), abs(int(query.min(initial=0)))) * self.most * len(query)

    def _limit(self, query: np.ndarray, at: int) -> int:
        """What a candidate that no list has shown down to depth ``at`` can score at most."""
        values = np.where(query > 0, self.sorted[len(self.ids) - 1 - at], self.sorted[at])
        if self._bound(query) < 2**63:
            return int(values @ query)
        return sum(int(a) * int(b) for a, b in zip(values, query, strict=True))

    def best(self, own: int, query: np.ndarray, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """(score, place) of the k best by score, then place, without row ``own``; those below ``least`` may lack."""
        n, falls, rises = len(self.ids), np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = self.rows == own
        at, step, top = 0, max(FIRST_STEP, k), []
        while at < n:
            to = min(n, at + step)
            met = np.zeros(n, bool)
            met[self.rising[n - to : n - at, falls].ravel()] = True
            met[self.rising[at:to, rises].ravel()] = True
            if not len(falls) and not len(rises):
                met[at:to] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            if len(new):
                got = self.scores(new, query)
                if len(top) == k:
                    new, got = new[got >= top[-1][0]], got[got >= top[-1][0]]
                chosen = np.lexsort((new, ~got))[:k]
                top = sorted(top + [(int(got[i]), int(new[i])) for i in chosen], key=lambda x: (-x[0], x[1]))[:k]
            known = [least] if least is not None else []
            floor = max(known + ([top[-1][0]] if len(top) == k else []), default=None)
            if seen.all() or floor is not None and self._limit(query, to - 1) < floor:
                break
            at, step = to, 2 * step
        return top if least is None else [x for x in top if x[0] >= least]


def _search(k: int):
    """Tasks read rows by block, candidates (query_row null) before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, lists = None, [], None
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(n).to_pylist() for n in ("dims", "block", "is_query", "row", "id", "least")]
            vectors = batch.column("v")
            values, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for place, (dims, block, is_query, row, own_id, least) in enumerate(zip(*columns, strict=True)):
                if (dims, block) != now:
                    now, held, lists = (dims, block), [], None
                vector = values[offsets[place] : offsets[place + 1]]
                if not is_query:
                    held.append((row, own_id, vector.copy()))
                    continue
                if lists is None and held:
                    lists, held = Lists([h[0] for h in held], [h[1] for h in held], np.array([h[2] for h in held], np.int64)), []
                if lists is not None:
                    out += [(row, own_id, lists.ids[i], s) for s, i in lists.best(row, vector, k, least)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["query_row", "query_id", "vec_id", "score"])
        give_back()

    return run


def _found(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Answers of every block that ``queries`` (row, id, v, dims, block, least) name."""
    columns = ["dims", "block", "is_query", "row", "id", "v", "least"]
    rows = candidates.withColumns({"is_query": F.lit(False), "least": F.lit(None).cast("long")}).select(columns).unionByName(queries.withColumn("is_query", F.lit(True)).select(columns))
    return rows.repartition("dims", "block").sortWithinPartitions("dims", "block", "is_query").mapInArrow(_search(k), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows of (row, id, v) with whole-number vectors."""
    blocks = max(1, -(-(candidates.agg(F.sum(F.size("v"))).first()[0] or 0) // block_numbers))
    sized = candidates.withColumns({"dims": F.size("v"), "block": F.pmod(F.xxhash64("row"), F.lit(blocks))})
    asked = queries.withColumn("dims", F.size("v"))
    first = stage(_found(sized.where("block = 0"), asked.withColumns({"block": F.lit(0).cast("long"), "least": F.lit(None).cast("long")}), k), "first-block")
    if blocks == 1:
        return _ranked(first, k).select("query_id", "rank", "vec_id", "score")
    floors = first.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_row").alias("row"), "least")
    others = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(blocks - 1).cast("long")))
    rest = _found(sized.where("block > 0"), asked.join(floors, "row", "left").withColumn("block", others), k)
    return _ranked(first.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


def vectors_of(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Written rows (row, id, v) of the usable vectors, numbered."""
    good = rows.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vector_col)).alias("v"))
    return stage(good.withColumn("row", F.monotonically_increasing_id()), "vectors")


def op3_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = vectors_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors.where("id % 100 = 0"), vectors)


OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id AS id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n AS query_row, q.id AS query_id, c.id AS vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.n <> c.n AND len(q.v) = len(c.v)
  WHERE q.id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
