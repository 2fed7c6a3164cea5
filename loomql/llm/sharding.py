"""Operator 6. Sharding by longest-processing-time scheduling.

Rows of one group must stay together; here a group is all documents with one
text, so that no copy is in two shards. Groups are sorted by size, largest
first, and each goes to the least-loaded shard, taken from a heap.

Groups of one size are interchangeable, so one task schedules the counts of
groups by size, and does the work of the heap for all groups of a size at once:
of c groups of size s it takes the c least of load + 0, s, 2s, ... over all
shards. The result is that of one heap over all groups, at any size. A corpus
of b bytes has at most sqrt(2 b) distinct sizes (1.4e7 for 100 TB), which bounds
that task. Every group has a rank among those of its size, by ranges, and the
first ranks go to the first shard, and so on. Rows join their group's shard; a
group that holds a third of all rows is one row on the groups' side, and the
rows' side of such a key can be split.

Cases. A null text is a group (of size 0), an empty text another. Equal loads go
to the first shard. Repeated rows are in one shard. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomql.llm.common import filled, ranked, staged

SHARDS = 64


def shares(loads: np.ndarray, size: int, count: int) -> np.ndarray:
    """How many of `count` groups of one size each shard gets from the heap;
    loads is updated."""
    out = np.zeros(len(loads), np.int64)
    if size == 0:
        out[np.argmin(loads)] = count
    elif count <= 2 * len(loads):
        heap = [(int(x), i) for i, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            x, i = heap[0]
            out[i] += 1
            heapq.heapreplace(heap, (x + size, i))
    else:
        below = lambda t: np.maximum(0, -((loads - t) // size))  # of load, load + size, ...: those less than t
        low, high = int(loads.min()), int(loads.min()) + size * (count + 1)
        while high - low > 1:  # the greatest t with at most `count` below it
            t = (low + high) // 2
            low, high = (t, high) if below(t).sum() <= count else (low, t)
        out = below(low)
        at = np.flatnonzero((loads <= low) & ((low - loads) % size == 0))
        out[at[: count - out.sum()]] += 1
    loads += out * size
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: Column | None = None, shards: int = SHARDS) -> DataFrame:
    """doc_id, group_key, n_bytes, shard of every row."""
    key = F.xxhash64(F.col(text_col), F.col(text_col).isNull()) if group is None else F.xxhash64(group, group.isNull())
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("group_key"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    rows = staged(rows, "sizes")
    groups = rows.groupBy("group_key").agg(F.sum("n_bytes").alias("size"))
    groups = ranked(groups, [F.col("size").desc(), F.col("group_key")], "size", "groups")

    def schedule(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "part"], ascending=[False, True])
        loads, out = np.zeros(shards, np.int64), []
        for size, own in pdf.groupby("size", sort=False):
            parts, ends = own["part"].to_numpy(), np.cumsum(own["n"].to_numpy())
            begins = ends - own["n"].to_numpy()
            share = shares(loads, int(size), int(ends[-1]))
            to = np.flatnonzero(share)
            first = np.cumsum(share)[to] - share[to]
            for at in np.union1d(first, begins):  # a run begins where a shard's ranks or a part begin
                p = np.searchsorted(ends, at, side="right")
                out.append((parts[p], size, at - begins[p], to[np.searchsorted(first, at, side="right") - 1]))
        return pd.DataFrame(out, columns=["part", "size", "rank", "shard"])

    counts = groups.groupBy("part", "size").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    runs = staged(counts.groupBy("all").applyInPandas(schedule, "part int, size long, rank long, shard int"), "runs")
    placed = filled(groups, runs, "size", ["shard"]).select("group_key", "shard")
    return rows.join(placed, "group_key").select("doc_id", "group_key", "n_bytes", "shard")
