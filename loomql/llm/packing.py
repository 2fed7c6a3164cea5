"""Operator 1. Cost-balanced packing of documents into training sequences.

The cost of n tokens that attend to each other is LINEAR * n + QUADRATIC * n**2.
Documents are taken in descending length; each goes to the sequence of lowest
cost among those with room for it, and a new one is opened only if none has.
Attention is masked at document ends, so costs of a sequence's documents add up.

Chunks of one length are interchangeable, and so are sequences that hold the
same lengths. The greedy is therefore run once for the whole corpus, on the
counts of chunks by length: sequences that have had the same assignments are
one interval of ids, of which there are at most about two for each length. The
result is that of one heap over all chunks, at any size. Every chunk has a rank
among those of its length, by ranges and without a gathered group, and takes
the place that the greedy gave that rank. Only ids and lengths are shuffled;
one task holds the counts (at most parts + capacity rows).

Cases. A text longer than a sequence is split into chunks of `capacity` tokens
and a rest, all of which are packed. Null texts and texts without tokens get no
row, so an empty table gives none. Repeated rows are packed each for itself.
Equal lengths go by id, nulls last. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomql.llm.common import filled, ranked, ship, staged
from loomql.llm.tokens import FOLDER, counter

CAPACITY = 4096
LINEAR, QUADRATIC = 1.0, 1 / 2048


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(counts: list[tuple[int, int]], capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Of (length, count) in descending length: runs (length, rank, count,
    sequence, first token), where chunks rank .. rank + count - 1 of that length
    go to the sequences from `sequence` on, one to each. Intervals of equal
    sequences wait in a heap by cost and first id; those without room for the
    length at hand wait by room, and come back when lengths have come down."""
    used = -(-sum(n * c for n, c in counts) // capacity)
    open_ = [(0.0, 0, used, 0)] if used else []  # cost, first id, ids, tokens
    full: list[tuple[int, float, int, int]] = []
    for n, left in counts:
        rank = 0
        while full and -full[0][0] >= n:
            room, c, i, m = heapq.heappop(full)
            heapq.heappush(open_, (c, i, m, capacity + room))
        while left:
            while open_ and capacity - open_[0][3] < n:
                c, i, m, tokens = heapq.heappop(open_)
                heapq.heappush(full, (tokens - capacity, c, i, m))
            if not open_:
                break
            c, i, m, tokens = heapq.heappop(open_)
            take = min(left, m)
            yield n, rank, take, i, tokens
            if take < m:
                heapq.heappush(open_, (c, i + take, m - take, tokens))
            heapq.heappush(open_, (c + cost(n), i, take, tokens + n))
            rank, left = rank + take, left - take
        if left:  # none has room: new sequences, each filled before the next is opened
            each = capacity // n
            for held, ids in ((each, left // each), (left % each, 1)):
                if held and ids:
                    c = 0.0
                    for k in range(held):
                        yield n, rank, ids, used, k * n
                        rank, c = rank + ids, c + cost(n)
                    heapq.heappush(open_, (c, used, ids, held * n))
                    used += ids


def lengths(docs: DataFrame, id_col: str, text_col: str, folder: str) -> DataFrame:
    """doc_id, tokens, row of each row with a text; row tells ties apart once
    the table is staged."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches):
        one, row = counter(folder).count, TaskContext.get().partitionId() << 40
        for b in batches:
            n = [one(t) for at in range(0, b.num_rows, 500) for t in b.column(1).slice(at, 500).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(np.arange(row, row + len(n)))], names=["doc_id", "tokens", "row"])
            row += len(n)

    return rows.mapInArrow(count, f"doc_id {kind}, tokens long, row long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, folder: str = FOLDER) -> DataFrame:
    """doc_id, chunk, n_tokens, sequence_id, first_token: where each chunk of
    each document is."""
    sized = staged(lengths(docs, id_col, text_col, folder).where("tokens > 0"), "lengths")
    piece = F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / capacity).cast("int")))
    parts = sized.select("doc_id", "row", "tokens", piece.alias("chunk"))
    parts = parts.select("doc_id", "row", "chunk", F.least(F.lit(capacity), F.col("tokens") - F.col("chunk") * capacity).cast("long").alias("n_tokens"))
    rows = ranked(parts, [F.col("n_tokens").desc(), F.col("doc_id").asc_nulls_last(), F.col("chunk"), F.col("row")], "n_tokens", "chunks")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "part"], ascending=[False, True])
        pieces = iter(zip(pdf["part"], pdf["n_tokens"], pdf["n"]))
        counts = pdf.groupby("n_tokens")["n"].sum().sort_index(ascending=False)
        out, part, begin, end = [], 0, 0, 0
        last = None
        for n, rank, take, sequence, token in pack([(int(k), int(v)) for k, v in counts.items()], capacity):
            if n != last:
                last, begin, end = n, 0, 0
            while take:
                if rank == end:  # the next part that holds chunks of this length
                    part, _, more = next(pieces)
                    begin, end = end, end + int(more)
                m = min(take, end - rank)
                out.append((part, n, rank - begin, sequence, token))
                rank, take, sequence = rank + m, take - m, sequence + m
        return pd.DataFrame(out, columns=["part", "n_tokens", "rank", "sequence_id", "first_token"])

    counts = rows.groupBy("part", "n_tokens").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    runs = staged(counts.groupBy("all").applyInPandas(place, "part int, n_tokens long, rank long, sequence_id long, first_token int"), "runs")
    out = filled(rows.drop("row"), runs, "n_tokens", ["sequence_id", "first_token"])
    return out.select("doc_id", "chunk", F.col("n_tokens").cast("int").alias("n_tokens"), (F.col("sequence_id") + F.col("ahead")).alias("sequence_id"), "first_token")
