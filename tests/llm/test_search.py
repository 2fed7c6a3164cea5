import random

import numpy as np
import pytest
from common_cases import CLASH

from loomql.llm import ann, topk


def table(spark, rows, extra=()):
    kinds = "vec_id long, embedding array<float>" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], kinds)


def brute(rows, k, every=50):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and len(v) == 8]
    out = {}
    for i, q in good:
        if i is not None and i % every == 0:
            found = sorted(((float(((v - q) ** 2).sum()), j is None, j or 0) for j, v in good if j != i))[:k]
            out.setdefault(i, set()).update((None if none else j, round(d, 5)) for d, none, j in found)
    return out


def made(rng, n):
    return [(i, rng.normal(size=8).round(2).tolist()) for i in range(n)]


@pytest.mark.parametrize("block,query_block", [(8192, 2048), (64, 3)])
def test_exact_search(spark, block, query_block):
    rng = np.random.default_rng(1)
    rows = made(rng, 400) + [(1000 + i, [1.0] * 8) for i in range(60)] + [(None, [0.5] * 8)]
    got = {}
    for r in topk.nearest(table(spark, rows), k=5, block=block, query_block=query_block).collect():
        got.setdefault(r["query_id"], set()).add((r["neighbour_id"], round(r["distance"], 5)))
    assert got == brute(rows, 5)


def test_bounds_lose_nothing():
    rng = np.random.default_rng(2)
    for dims in (1, 5, 8, 17, 64):
        x = rng.normal(size=(dims, 300)) * rng.exponential(size=(dims, 1))
        rest = np.sqrt(np.cumsum((x**2)[::-1], axis=0)[::-1])
        ids = np.arange(300)
        for _ in range(20):
            q = rng.normal(size=dims)
            at, d = topk.search(x, rest, ids, ids, q, 7)
            want = ((x - q[:, None]) ** 2).sum(axis=0)
            assert (at == np.lexsort((ids, want))[:7]).all() and np.allclose(d, want[at])


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact, close = {}, {}
    for df, to in ((topk.nearest(rows), exact), (ann.nearest(rows), close)):
        for r in df.collect():
            to.setdefault(r["query_id"], {})[r["neighbour_id"]] = r["distance"]
    assert exact.keys() == close.keys()
    assert np.mean([len(exact[q].keys() & close[q].keys()) / len(exact[q]) for q in exact]) >= 0.9
    assert all(abs(d - exact[q][n]) < 2e-6 for q in close for n, d in close[q].items() if n in exact[q])


def test_hot_vectors(spark):
    """A third of all rows is one vector: each has k neighbours at distance 0."""
    rng = np.random.default_rng(3)
    rows = made(rng, 200) + [(1000 + i, [1.0] * 8) for i in range(120)]
    for nearest in (topk.nearest, ann.nearest):
        got = [r for r in nearest(table(spark, rows), k=4).collect() if r["query_id"] >= 1000]
        assert {r["query_id"] for r in got} == {1000, 1050, 1100} and all(r["distance"] == 0 for r in got)
        assert [r["neighbour_id"] for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == [1001, 1002, 1003, 1004, 1000, 1001, 1002, 1003, 1000, 1001, 1002, 1003]


@pytest.mark.parametrize("nearest", [topk.nearest, ann.nearest])
def test_cases(spark, nearest):
    rng = np.random.default_rng(4)
    rows = made(rng, 60) + [(100, None), (150, []), (200, [1.0] * 7), (250, [float("nan")] * 8), (300, [None] * 8), (350, [float("inf")] * 8), (None, [1.0] * 8), (0, rng.normal(size=8).tolist())]
    got = nearest(table(spark, rows, CLASH), k=3).collect()
    assert {r["query_id"] for r in got} == {0, 50} and all(r["neighbour_id"] != r["query_id"] for r in got)
    assert nearest(table(spark, [])).count() == 0 and nearest(table(spark, [(0, [1.0] * 8)])).count() == 0
    assert len(nearest(table(spark, [(0, [1.0] * 8), (1, [2.0] * 8)]), k=5).collect()) == 1


def test_probes_come_in_order_of_success():
    rng = random.Random(5)
    sets = ann.order_of_sets(4, 40)
    assert sets[0] == [] and all(len({min(j, 7 - j) for j in s}) == len(s) for s in sets) and len(set(map(tuple, sets))) == 40
    at = np.array([[[rng.random() * 9 for _ in range(4)]] for _ in range(50)])
    keys = ann.probes(at, 9)
    assert (keys[:, :, 0] == ann.bucket(np.floor(at))).all() and all(len(set(k[0])) == 9 for k in keys)
    low, part = np.floor(at), at - np.floor(at)
    for i in range(50):  # the first probe beyond the own bucket crosses the nearest border
        m = int(np.argmin(np.minimum(part[i, 0], 1 - part[i, 0])))
        moved = low[i : i + 1].copy()
        moved[0, 0, m] += -1 if part[i, 0, m] < 0.5 else 1
        assert keys[i, 0, 1] == ann.bucket(moved)[0, 0]


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    got = topk.nearest(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(topk.SQL).fetchall())
