"""Operator 8. Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables has HASHES functions floor((a . v + b) / width) with normal
a (p-stable for p = 2). A row is in one bucket of each table. A query visits
PROBES buckets of each: its own, and those where some functions are moved by one,
in ascending order of the sum of squared distances to the borders crossed, which
is the descending order of the estimated chance of success. Rows met in any table
are merged, and ranked by their exact distance.

Every row is indexed. Only `width` is fitted: WIDTH times the median distance to
the k-th neighbour within a sample of SAMPLE rows at most. Rows and probes meet by
bucket in sorted partitions, where probes lie before rows, so a bucket streams
through a task in blocks. Rows of equal vectors count as one vector with its
k + 1 least ids, found by a limited rank, so a hot vector fills no bucket, and
queries of equal vectors are one probe set; as no vector has more than k + 1
neighbours of use, nothing is lost.

Cases. As for exact search (topk): no row is its own neighbour, vectors that can't
be compared are left out, equal distances go by id, nulls last, an empty table
gives no rows and other columns are ignored. A query that meets fewer than k rows
gets fewer.
"""

from __future__ import annotations

import heapq
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomql.llm.common import mix, ship, staged
from loomql.llm.topk import EVERY, NEIGHBOURS, least, matrix, usable

TABLES, HASHES, PROBES = 8, 5, 64
WIDTH = 1.05
SAMPLE = 2000
BLOCK = 4096  # rows of a bucket at once
FOLD = 1_000_000  # candidates held before they are cut to k a query


@cache
def functions(dims: int, tables: int, hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.normal(size=(dims, tables * hashes)), rng.random(tables * hashes)


def places(v: np.ndarray, width: float, tables: int, hashes: int, seed: int) -> np.ndarray:
    """[rows, tables, hashes]: places along each line, in widths."""
    a, b = functions(v.shape[1], tables, hashes, seed)
    return (v @ a / width + b).reshape(-1, tables, hashes)


def bucket(at: np.ndarray) -> np.ndarray:
    """A hash of the floors [..., hashes]."""
    out = np.zeros(at.shape[:-1], np.uint64)
    for j in range(at.shape[-1]):
        out = mix(out ^ at[..., j].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1))
    return out.view(np.int64)


@cache
def order_of_sets(hashes: int, most: int) -> list[list[int]]:
    """Perturbation sets over 2 * hashes ranked scores, in the order of their
    expected sums; rank j and rank 2 * hashes - 1 - j are two ways of one function."""
    m = hashes
    expected = [(j + 1) * (j + 2) / (4 * (m + 1) * (m + 2)) if j < m else 1 - (2 * m - j) / (m + 1) + (2 * m - j) * (2 * m - j + 1) / (4 * (m + 1) * (m + 2)) for j in range(2 * m)]
    out: list[list[int]] = [[]]
    heap = [(expected[0], (0,))]
    while heap and len(out) < most:
        total, own = heapq.heappop(heap)
        if all(2 * m - 1 - j not in own for j in own):
            out.append(list(own))
        n = own[-1] + 1
        if n < 2 * m:
            heapq.heappush(heap, (total - expected[own[-1]] + expected[n], (*own[:-1], n)))
            heapq.heappush(heap, (total + expected[n], (*own, n)))
    return out


def probes(at: np.ndarray, most: int) -> np.ndarray:
    """[rows, tables, sets] buckets to visit for places [rows, tables, hashes]."""
    m = at.shape[-1]
    low = np.floor(at)
    part = at - low
    cost = np.concatenate([part, 1 - part], axis=-1)  # to the lower, to the upper border
    rank = np.argsort(cost, axis=-1)
    # of the 2m scores, the r-th least and the r-th greatest belong to one function
    sets = order_of_sets(m, most)
    out = np.empty((*at.shape[:-1], len(sets)), np.int64)
    for s, own in enumerate(sets):
        moved = low.copy()
        for j in own:
            which = rank[..., j : j + 1]
            np.put_along_axis(moved, which % m, np.take_along_axis(low, which % m, -1) + np.where(which < m, -1, 1), -1)
        out[..., s] = bucket(moved)
    return out


def fit_width(good: DataFrame, k: int, sample: int) -> float:
    n = good.count()
    if not n:
        return 1.0
    some = good.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.2 * sample / n))).select("v").limit(sample).toPandas()["v"]
    if len(some) < 2:
        return 1.0
    v = np.stack(some.to_list())
    square = (v**2).sum(axis=1)
    d = np.maximum(square[:, None] + square - 2 * v @ v.T, 0.0)
    kth = np.partition(d, min(k, len(v) - 1), axis=1)[:, min(k, len(v) - 1)]
    width = WIDTH * float(np.sqrt(np.median(kth)))
    return width if width > 1e-9 else 1.0


def nearest(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", queries: Column | None = None, k: int = NEIGHBOURS, tables: int = TABLES, hashes: int = HASHES, most: int = PROBES, seed: int = 1, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, neighbour_id, distance (squared, 6 places)."""
    ship(rows.sparkSession)
    good, dims = usable(rows, id_col, vector_col)
    good = good.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(3))})
    width = fit_width(good, k, sample)
    copies = Window.partitionBy("h1", "h2").orderBy(F.col("id").asc_nulls_last())
    indexed = good.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).select("id", "v", (F.col("n") == 1).alias("first"), "h1", "h2")
    indexed = staged(indexed, "vectors")
    asked = good.where(F.col("id") % EVERY == 0 if queries is None else queries)
    vectors = asked.groupBy("h1", "h2").agg(F.first("v").alias("v"))

    def index(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                b = whole.slice(begin, 1000)
                v = matrix(b.column(2), dims)
                key = bucket(np.floor(places(v, width, tables, hashes, seed)))
                yield emit(b, key, np.tile(np.arange(tables), len(v)), v, np.repeat(np.arange(len(v)), tables), True)

    def visit(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 200):
                b = whole.slice(begin, 200)
                v = matrix(b.column(2), dims)
                key = probes(places(v, width, tables, hashes, seed), most)
                sets = key.shape[-1]
                yield emit(b, key, np.tile(np.repeat(np.arange(tables), sets), len(v)), v, np.repeat(np.arange(len(v)), tables * sets), False)

    def emit(b, key, table, v, of, is_row):
        flat = v.astype(np.float64)[of]
        held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * dims), len(of), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())
        at = pa.array(of)
        return pa.RecordBatch.from_arrays([pa.array(table.astype(np.int32)), pa.array(key.ravel()), pa.array(np.full(len(of), is_row)), b.column(0).take(at), b.column(1).take(at), held], names=["t", "bucket", "is_row", "h1", "h2", "v"])

    kind = "t int, bucket long, is_row boolean, h1 long, h2 long, v binary"
    met = indexed.where("first").select("h1", "h2", "v").mapInArrow(index, kind).union(vectors.select("h1", "h2", "v").mapInArrow(visit, kind))
    met = met.repartition("t", "bucket").sortWithinPartitions("t", "bucket", "is_row")

    def rank(batches):
        held, size, last, asked_, square = [], 0, None, None, None
        waiting: list[tuple] = []

        def fold():
            q1, q2, n1, n2, d = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((n2, n1, d, q2, q1))
            q1, q2, n1, n2, d = (x[order] for x in (q1, q2, n1, n2, d))
            same = (q1[1:] == q1[:-1]) & (q2[1:] == q2[:-1])
            keep = np.append(True, ~(same & (n1[1:] == n1[:-1]) & (n2[1:] == n2[:-1])))
            q1, q2, n1, n2, d = (x[keep] for x in (q1, q2, n1, n2, d))
            new = np.append(True, (q1[1:] != q1[:-1]) | (q2[1:] != q2[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(len(q1)), 0))
            top = np.arange(len(q1)) - start <= k  # k + 1 vectors: one may be the query's own
            return tuple(x[top] for x in (q1, q2, n1, n2, d))

        for b in batches:
            if not b.num_rows:
                continue
            t, key, is_row = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            h1, h2 = b.column(3).to_numpy(), b.column(4).to_numpy()
            raw = b.column(5)
            first = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset]
            v = np.frombuffer(raw.buffers()[2], np.float64, b.num_rows * dims, first).reshape(-1, dims)
            new = np.flatnonzero(np.append((t[0], key[0]) != last, (t[1:] != t[:-1]) | (key[1:] != key[:-1])))
            starts = new if len(new) and new[0] == 0 else np.append(0, new)
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
                if (t[a], key[a]) != last:
                    last, waiting, asked_ = (t[a], key[a]), [], None
                cut = a + int((~is_row[a:z]).sum())
                if cut > a:
                    waiting.append((h1[a:cut], h2[a:cut], v[a:cut]))
                if cut == z or not waiting:
                    continue
                if asked_ is None:
                    asked_ = tuple(np.concatenate(x) for x in zip(*waiting))
                    square = (asked_[2] ** 2).sum(axis=1)
                for at in range(cut, z, BLOCK):
                    x = v[at : min(at + BLOCK, z)]
                    own = (x**2).sum(axis=1)
                    for q in range(0, len(square), BLOCK):
                        d = np.maximum(square[q : q + BLOCK, None] + own - 2 * (asked_[2][q : q + BLOCK] @ x.T), 0.0)
                        if d.shape[1] > k + 1:
                            c = np.argpartition(d, k, axis=1)[:, : k + 1]
                            d = np.take_along_axis(d, c, 1)
                        else:
                            c = np.broadcast_to(np.arange(d.shape[1]), d.shape)
                        r = np.repeat(np.arange(q, q + len(d)), d.shape[1])
                        c = c.ravel() + at
                        held.append((asked_[0][r], asked_[1][r], h1[c], h2[c], d.ravel()))
                        size += len(r)
                if size > FOLD:
                    held = [fold()]
                    size = len(held[0][0])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in fold()], names=["q1", "q2", "h1", "h2", "d"])

    close = met.mapInArrow(rank, "q1 long, q2 long, h1 long, h2 long, d double")
    order = Window.partitionBy("q1", "q2").orderBy("d", "h1", "h2")
    close = close.groupBy("q1", "q2", "h1", "h2").agg(F.min("d").alias("d")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    named = close.join(indexed.select("id", "h1", "h2"), ["h1", "h2"]).select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), F.col("id").alias("neighbour_id"), F.col("d").alias("distance"))
    pairs = asked.select(F.col("id").alias("query_id"), "h1", "h2").join(named, ["h1", "h2"]).where("query_id is distinct from neighbour_id").select("query_id", "neighbour_id", "distance")
    return least(pairs, k)
