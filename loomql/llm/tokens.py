"""Operator 7. Token counts, with overlap resynchronisation of huge documents.

A text of more than `chunk` characters is cut into chunks that overlap their
right neighbours. Chunks are spread over all tasks and encoded with offsets.
A boundary is where a pre-token starts. What a scan finds right of a boundary
depends on the text right of it alone, so two scans that share a boundary agree
from there on; and the left chunk's boundaries are those of the whole text, by
induction, but for the last two, which its cut end may have moved. Hence a
boundary that both chunks have in the overlap is proven, and the counts are
spliced there. Where an overlap holds none, the document is done again with
overlaps and chunks widened fourfold, until one chunk holds it whole.

Only texts beyond one chunk are cut and shuffled; the rest are counted in place.

Cases. A null text has a null count, an empty one 0. Every row is counted, also
repeated ones and those without an id: rows equal in id and text are cut alike,
spliced once and counted as often as they are there. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomql.llm.common import row_key, ship, staged

FOLDER = "/opt/tokenizers"
CHUNK = 32_768  # characters
OVERLAP = 512
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE_START = re.compile(r" (?=\S)")
UNEVEN = re.compile(r" \s| $")


class Counter(dict):
    """Counts tokens of byte-level BPE. A space before a non-space always starts
    a pre-token, so a text's count is the sum over its pieces cut there; counts
    of pieces are remembered, `most` at a time."""

    def __init__(self, folder: str, most: int = 400_000):
        import tiktoken

        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.most = most

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.encoding.encode_ordinary(" " + piece))
        return n

    def count(self, text: str) -> int:
        if len(self) > self.most:
            self.clear()
        first, *rest = SPACE_START.split(text) if UNEVEN.search(text) else text.split(" ")
        if not first and rest and text[0] == " ":
            return sum(map(self.__getitem__, rest))
        return len(self.encoding.encode_ordinary(first)) + sum(map(self.__getitem__, rest))


@cache
def counter(folder: str) -> Counter:
    return Counter(folder)


@cache
def offsets_encoder(folder: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
    made.encode_special_tokens = True
    return made


def chunks(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """First and end character of each chunk."""
    n = max(1, -(-(length - overlap) // chunk))
    return [(i * chunk, length if i == n - 1 else (i + 1) * chunk + overlap) for i in range(n)]


def boundaries(folder: str, text: str, base: int, left: int, right: int, final: bool) -> tuple[int, list[int], list[int], list[int], list[int]]:
    """Of a chunk that starts at character `base`: its tokens, and the places of
    boundaries before `left` and from `right` on, with the tokens before each."""
    found = offsets_encoder(folder).encode(text, add_special_tokens=False)
    words = np.fromiter((-1 if w is None else w for w in found.word_ids), np.int64, len(found))
    starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(found)) + base
    new = np.flatnonzero(np.diff(words, prepend=-2))
    sure = new if final else new[:-2]
    a, b = new[starts[new] < left], sure[starts[sure] >= right]
    return len(found), starts[a].tolist(), a.tolist(), starts[b].tolist(), b.tolist()


def splice(parts: list[dict]) -> int | None:
    """The tokens of a document from its chunks in order; None where two
    neighbours share no proven boundary."""
    total, begin = 0, 0
    for one, two in zip(parts, parts[1:]):
        later = dict(zip(two["left_at"], two["left_n"]))
        met = next(((n, later[at]) for at, n in zip(one["right_at"], one["right_n"]) if at in later), None)
        if met is None:
            return None
        total += met[0] - begin
        begin = met[1]
    return total + parts[-1]["tokens"] - begin


def _plain(docs: DataFrame, id_col: str, text_col: str, folder: str) -> DataFrame:
    """doc_id, n_tokens, n_chunks of rows whose texts are done whole."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        count = counter(folder).count
        for b in batches:
            n = [None if t is None else count(t) if t else 0 for at in range(0, b.num_rows, 500) for t in b.column(1).slice(at, 500).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(np.ones(len(n), np.int32))], names=["doc_id", "n_tokens", "n_chunks"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_chunks int")


def _pass(docs: DataFrame, id_col: str, text_col: str, folder: str, chunk: int, overlap: int) -> DataFrame:
    """h1, h2, doc_id, n_tokens (null: to be widened), n_chunks, copies of the
    rows of more than chunk + overlap characters; rows equal in id and text are
    one with `copies`, as their chunks are the same."""
    h1, h2 = row_key(id_col, text_col)
    rows = docs.select(h1.alias("h1"), h2.alias("h2"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                t = batch.column(3)[i].as_py()
                spans = chunks(len(t), chunk, overlap)
                for at in range(0, len(spans), 64):
                    some = spans[at : at + 64]
                    r = batch.take(pa.array([i] * len(some), pa.int64()))
                    part = pa.array(range(at, at + len(some)), pa.int32())
                    of, text = pa.array([len(spans)] * len(some), pa.int32()), pa.array([t[a:z] for a, z in some], pa.string())
                    yield pa.RecordBatch.from_arrays([*r.columns[:3], part, of, text], names=["h1", "h2", "doc_id", "part", "parts", "text"])

    def encode(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                part, of, text = (b.column(i).to_pylist() for i in (3, 4, 5))
                n, lists = [], ([], [], [], [])
                for k, z, t in zip(part, of, text):
                    base = k * chunk
                    tokens, *got = boundaries(folder, t, base, base + overlap if k else -1, base + chunk, k == z - 1)
                    n.append(tokens)
                    for held, x in zip(lists, got):
                        held.append(x)
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(n, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], names=["h1", "h2", "doc_id", "part", "parts", "tokens", "left_at", "left_n", "right_at", "right_n"])

    def join(batches):
        held: list[dict] = []

        def done():
            n = splice([p for k, p in enumerate(held) if not k or p["part"] != held[k - 1]["part"]])
            p = held[0]
            values = [p["h1"], p["h2"], p["doc_id"], n, p["parts"], sum(x["part"] == 0 for x in held)]
            kinds = [pa.int64(), pa.int64(), id_type, pa.int64(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], names=["h1", "h2", "doc_id", "n_tokens", "n_chunks", "copies"])

        for b in batches:
            id_type = b.schema.field(2).type
            for p in b.to_pylist():
                if held and (p["h1"], p["h2"]) != (held[0]["h1"], held[0]["h2"]):
                    yield done()
                    held = []
                held.append(p)
        if held:
            yield done()

    key = f"h1 long, h2 long, doc_id {kind}, part int, parts int"
    cuts = rows.mapInArrow(cut, f"{key}, text string").repartition("h1", "h2", "part")
    lists = "left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"
    parts = cuts.mapInArrow(encode, f"{key}, tokens long, {lists}").repartition("h1", "h2").sortWithinPartitions("h1", "h2", "part")
    return parts.mapInArrow(join, f"h1 long, h2 long, doc_id {kind}, n_tokens long, n_chunks int, copies long")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, n_chunks of every row."""
    ship(docs.sparkSession)
    docs = docs.select(id_col, text_col)
    huge = F.coalesce(F.length(F.col(text_col)) > chunk + overlap, F.lit(False))
    out = _plain(docs.where(~huge), id_col, text_col, folder)
    docs = docs.where(huge)
    while True:
        got = staged(_pass(docs, id_col, text_col, folder, chunk, overlap), "tokens")
        good = got.where("n_tokens is not null").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        out = out.union(good.select("doc_id", "n_tokens", "n_chunks"))
        failed = got.where("n_tokens is null").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
        if failed.isEmpty():
            return out
        h1, h2 = row_key(id_col, text_col)
        docs = docs.withColumns({"_h1": h1, "_h2": h2}).join(failed, ["_h1", "_h2"], "left_semi").select(id_col, text_col)
        chunk, overlap = 4 * chunk, 4 * overlap
