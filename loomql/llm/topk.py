"""Operator 5. Exact top-k search by columnar branch and bound.

Vectors lie in blocks, turned so that a dimension's values stand side by side.
For each query, squared distances are added up a block of dimensions at a time.
What remains is bounded by the masses of the rest of both vectors: it is at least
(|x| - |q|)**2 and at most (|x| + |q|)**2 over the dimensions to come. A candidate
whose least exceeds the k-th smallest of all mosts is out; once half are out, the
survivors are compacted. Survivors' distances are summed anew, dimension by
dimension, so they are the same in any block.

A stated set of queries is searched against all rows: queries lie in blocks of
QUERY_BLOCK, rows in blocks of BLOCK, and every pair of blocks is one group, so
a row is sent once for each block of queries. Each pair returns k rows a query,
and the least k of these are kept, first within the task, then over all.

Cases. A row is not its own neighbour, nor are rows of the same id. Vectors that
are null, empty, hold a null, NaN or infinity, or differ from most in length are
neither queries nor found (`dims` is the most frequent length, the greater if
several are). Equal distances go by id, nulls last. Repeated rows are found each
for itself. Fewer than k rows give fewer neighbours. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomql.llm.common import ship

NEIGHBOURS = 10
BLOCK = 8192
QUERY_BLOCK = 2048
STEP = 8  # dimensions
EVERY = 50  # a row is a query if its id is divisible by this


def usable(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """id, v of the rows whose vectors can be compared, and their length."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where((F.size(v) > 0) & ~odd)
    size = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dims = size["d"] if size else 0
    return good.where(F.size("v") == dims), dims


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def distance(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of the columns of x to q, summed dimension by dimension."""
    total = np.zeros(x.shape[1])
    for j in range(len(q)):
        total += (x[j] - q[j]) ** 2
    return total


def search(x: np.ndarray, rest: np.ndarray, ids: np.ndarray, alive: np.ndarray, q: np.ndarray, k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k columns of x [dims, rows] that are nearest to q, and their
    distances. rest: the masses of the columns from each dimension on; alive:
    the places that are candidates."""
    dims = len(q)
    mass = np.sqrt(np.append(np.cumsum((q**2)[::-1])[::-1], 0.0))
    now, part = x[:, alive] if len(alive) < x.shape[1] else x, np.zeros(len(alive))
    left = rest[:, alive] if len(alive) < x.shape[1] else rest
    for at in range(0, dims, step):
        if len(alive) <= k:
            break
        end = min(at + step, dims)
        for j in range(at, end):
            part += (now[j] - q[j]) ** 2
        more = left[end] if end < dims else 0.0
        most = np.partition(part + (more + mass[end]) ** 2, k - 1)[k - 1]
        live = part + (more - mass[end]) ** 2 <= most * (1 + 1e-9) + 1e-12
        if live.sum() * 2 <= len(alive) or end == dims:
            alive, part, now, left = alive[live], part[live], now[:, live], left[:, live]
    d = distance(now, q)
    order = np.lexsort((ids[alive], d))[:k]
    return alive[order], d[order]


def nearest(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", queries: Column | None = None, k: int = NEIGHBOURS, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, neighbour_id, distance (squared, 6 places) of every row
    that `queries` holds for (by default: whose id is divisible by EVERY)."""
    ship(rows.sparkSession)
    good, dims = usable(rows, id_col, vector_col)
    asked = good.where(F.col("id") % EVERY == 0 if queries is None else queries)
    n, m = good.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    # a block follows the hash of a row, so each holds about its share, and any task can tell
    spread = lambda df, own, parts: df.withColumn(own, F.pmod(F.xxhash64("id", "v", F.lit(5)), F.lit(parts)).cast("int"))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    base = spread(good, "b", blocks).withColumn("q", every(query_blocks))
    ask = spread(asked, "q", query_blocks).withColumn("b", every(blocks))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            x = np.ascontiguousarray(matrix(left.column("v").combine_chunks(), dims).T)
            ids = np.array([np.iinfo(np.int64).max if i is None else i for i in left.column("id").to_pylist()], np.int64)
            rest = np.sqrt(np.cumsum((x**2)[::-1], axis=0)[::-1])
            whole = np.arange(len(ids))
            for own, q in zip(right.column("id").to_pylist(), matrix(right.column("v").combine_chunks(), dims)):
                at, d = search(x, rest, ids, whole if own is None else np.flatnonzero(ids != own), q, k)
                out.append((np.full(len(at), own if own is not None else -1), at, d))
        query, at, d = (np.concatenate(v) if out else np.empty(0, np.int64) for v in (zip(*out) if out else ((), (), ())))
        return pa.table({"query_id": pa.array(query, pa.int64()), "neighbour_id": left.column("id").take(pa.array(at.astype(np.int64))) if len(at) else pa.array([], pa.int64()), "distance": pa.array(d, pa.float64())})

    pairs = base.groupBy("b", "q").cogroup(ask.groupBy("b", "q")).applyInArrow(compare, "query_id long, neighbour_id long, distance double")
    return least(pairs, k)


def least(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query; Spark cuts each task's rows to k a query
    before they are shuffled (a window with a limit on its rank)."""
    order = Window.partitionBy("query_id").orderBy("distance", F.col("neighbour_id").asc_nulls_last())
    top = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "neighbour_id", F.round("distance", 6).alias("distance"))


SQL = f"""
WITH e AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (
    SELECT a.id AS query_id, b.id AS neighbour_id, pow(list_distance(a.v, b.v), 2) AS distance
    FROM e a, e b WHERE a.id % {EVERY} = 0 AND a.id <> b.id),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, round(distance, 6) AS distance FROM ranked WHERE rank <= {NEIGHBOURS}
"""
