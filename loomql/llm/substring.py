"""Operator 3. Repeated passages by chaining of shared k-mers and alignment.

Seeds are k-mers of words, chosen by the least hash in each window of W, so two
texts that share a run of W + K - 1 words share a seed. Of a seed that several
documents hold, one place is the anchor: that in the document with the least key.
Every other place is matched with the anchor alone, so a passage that n documents
share gives n - 1 links, not n * n, and all its copies stay linked through it.
The anchor is a grouped minimum, combined before the shuffle; a seed that a third
of all documents hold is one row on its side of the join.

A document's matches with one anchor document are joined along diagonals into
segments, and segments into chains of greatest score, less a cost for gaps, by a
Fenwick tree of prefix maxima. Chains are aligned on the words of both documents:
matched word for word along each diagonal, by dynamic programming in the gaps,
and outwards until the score drops. Pieces with IDENTITY that touch become one
passage, found if it has `least` words.

A link always leads to a document with a lesser key, so the copy in the document
with the least key of all stays, and cut() leaves one copy of every passage.

Cases. Null and empty texts and texts of under K words have no seeds. Rows equal
in id and text are one document; a text repeated within one document only isn't
a passage. A very long text is one group of matches, in proportion to its length.
Equal scores go to the first place. An empty table gives no rows. Other columns,
also of clashing names, are kept by cut() and ignored by passages().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomql.llm.common import arrow_rows, mix, row_key, ship, staged, unstage, whole_groups, words_of
from loomql.llm.secrets import edited

K, W = 8, 12
LEAST = 50  # words of a passage
PIECE = 16  # words of an aligned piece
IDENTITY = 0.8
GAP = 64  # words that a chain may skip
GAP_COST = 0.1
MARGIN = 64  # words on either side of a chain that are aligned as well


def seeds_of(word: np.ndarray, row: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word (within all) of each chosen k-mer. One that its
    text had shortly before is hashed as the n-th of its kind, so that texts in
    which words or lines go on repeating match place by place."""
    n = len(word) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word[j : n + j]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    h, of = mix(h[at]), row[at]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))[: len(of)]
    size = np.diff(np.append(first, len(of)))
    chosen = np.zeros(len(of), bool)
    m = len(of) - w + 1
    if m > 0:
        low = np.arange(m)
        value = h[:m].copy()
        for j in range(1, w):
            less = h[j : m + j] < value
            np.copyto(low, np.arange(j, m + j), where=less)
            np.copyto(value, h[j : m + j], where=less)
        chosen[low[of[:m] == of[w - 1 :]]] = True
    for i in np.flatnonzero(size < w):  # a short text: one window
        chosen[first[i] + np.argmin(h[first[i] : first[i] + size[i]])] = True
    h, of, at = h[chosen], of[chosen], at[chosen]
    order = np.lexsort((at, h, of))
    same = (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1]) & (np.diff(at[order]) <= GAP)
    fresh = np.append(True, ~same)[: len(h)]
    turn = np.empty(len(h), np.int64)
    turn[order] = np.arange(len(h)) - np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
    again = turn > 0
    h[again] = mix(h[again] + turn[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h, of, at


def seeds(docs: DataFrame, id_col: str, text_col: str, k: int, w: int) -> DataFrame:
    """seed, at: k-mer hash, and key and word of its place."""
    h1, _ = row_key(id_col, text_col)
    rows = docs.select(h1.alias("key"), F.col(text_col).alias("text")).where(F.length("text") > 0)

    def run(batches):
        def one(b):
            word, row, _, _ = words_of(b.column(1))
            h, of, at = seeds_of(word, row, k, w)
            first = np.searchsorted(row, np.arange(b.num_rows))
            key = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key[of]), pa.array((at - first[of]).astype(np.int32))], names=["seed", "key", "x"])

        yield from arrow_rows(one)(batches)

    return rows.mapInArrow(run, "seed long, key long, x int")


def words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, doc_id, words: two bytes of each word's hash, one row a document."""
    h1, _ = row_key(id_col, text_col)
    rows = docs.select(h1.alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        def one(b):
            word, row, _, _ = words_of(b.column(2))
            raw = (word >> np.uint64(48)).astype(np.uint16).tobytes()
            first = np.searchsorted(row, np.arange(b.num_rows + 1)) * 2
            offsets = pa.py_buffer(first.astype(np.int32).tobytes())
            held = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, offsets, pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), held], names=["key", "doc_id", "words"])

        yield from arrow_rows(one)(batches)

    return rows.mapInArrow(run, f"key long, doc_id {kind}, words binary")


def chain(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, worth: np.ndarray) -> list[list[int]]:
    """Chains of segments that go forward in x and y, the best first, each
    segment in one. A chain's score is the worth of its segments less GAP_COST
    for every word skipped in x or y. As that cost is a difference of sums, the
    best predecessor is a prefix maximum over y, kept in a Fenwick tree while
    segments are taken by x; ends enter the tree once a start lies beyond them."""
    n = len(x0)
    places, rank = np.unique(np.concatenate([y0, y1]), return_inverse=True)
    start, end = (rank[:n] + 1).tolist(), (rank[n:] + 1).tolist()
    top = len(places)
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (top + 1)
    score, before = worth.astype(float).tolist(), [-1] * n
    by_start, by_end = np.argsort(x0, kind="stable").tolist(), np.argsort(x1, kind="stable").tolist()
    xs, xe, ys, ye = x0.tolist(), x1.tolist(), y0.tolist(), y1.tolist()
    done = 0
    for i in by_start:
        while done < n and xe[by_end[done]] <= xs[i]:
            j = by_end[done]
            done += 1
            value = (score[j] + GAP_COST * (xe[j] + ye[j]), j)
            at = end[j]
            while at <= top:
                if value[0] > tree[at][0]:
                    tree[at] = value
                at += at & -at
        best, at = (-np.inf, -1), start[i]
        while at:
            if tree[at][0] > best[0]:
                best = tree[at]
            at -= at & -at
        gain = best[0] - GAP_COST * (xs[i] + ys[i])
        if gain > 0 and xs[i] - xe[best[1]] <= GAP and ys[i] - ye[best[1]] <= GAP:
            score[i] += gain
            before[i] = best[1]
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        held = []
        while i >= 0 and not used[i]:
            used[i] = True
            held.append(i)
            i = before[i]
        if held:
            out.append(held[::-1])
    return out


def chains_of(t: pa.Table, k: int, w: int) -> pa.RecordBatch:
    """Chains of whole groups of matches: key, anchor, and the segments' x0, x1
    and diagonals."""
    key, anchor, x, y = (t.column(i).to_numpy() for i in range(4))
    x, y = x.astype(np.int64), y.astype(np.int64)
    order = np.lexsort((x, x - y, anchor, key))
    key, anchor, x, y = key[order], anchor[order], x[order], y[order]
    d = x - y
    if not len(x):
        new = np.empty(0, bool)
    else:
        new = np.append(True, (key[1:] != key[:-1]) | (anchor[1:] != anchor[:-1]) | (d[1:] != d[:-1]) | (np.diff(x) > GAP))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    step = np.append(0, np.diff(x))
    step[first] = 0
    step[step > w] = k
    worth = (np.add.reduceat(step, first) if len(first) else step[:0]) + k
    x0, x1, d, key, anchor = x[first], x[last] + k, d[first], key[first], anchor[first]
    # a segment within a longer one of the document whose seeds lie close adds nothing
    order = np.lexsort((-x1, x0, key))
    base = np.cumsum(np.append(True, key[order][1:] != key[order][:-1])[: len(order)]) * (int(x1.max(initial=0)) + 1)
    dense = np.where(worth[order] >= (x1 - x0)[order], x1[order] + base, 0)
    beyond = np.append(0, np.maximum.accumulate(dense)[:-1])[: len(order)]
    stays = np.ones(len(order), bool)
    stays[order] = beyond < x1[order] + base
    x0, x1, d, key, anchor, worth = (v[stays] for v in (x0, x1, d, key, anchor, worth))
    pair = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (anchor[1:] != anchor[:-1]))[: len(key)])
    out: list[tuple] = []
    for a, z in zip(pair.tolist(), np.append(pair[1:], len(key)).tolist()):
        s = slice(a, z)
        for found in [[0]] if z - a == 1 else chain(x0[s], x1[s], x0[s] - d[s], x1[s] - d[s], worth[s]):
            i = np.array(found) + a
            out.append((key[a], anchor[a], x0[i].tolist(), x1[i].tolist(), d[i].tolist(), int(x0[i[0]]), int(x1[i[-1]]), int(x0[i[0]] - d[i[0]]), int(x1[i[-1]] - d[i[-1]])))
    kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3, *[pa.int32()] * 4]
    cols = list(zip(*out)) if out else [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds)], names=["key", "anchor", "x0", "x1", "d", "xa", "xz", "ya", "yz"])


CHAIN = "key long, anchor long, x0 array<int>, x1 array<int>, d array<int>, xa int, xz int, ya int, yz int"


def outwards(same: np.ndarray) -> int:
    """How far a run of matches goes: to the greatest sum of +1 a match and -2 a
    miss, before the sum has dropped by 8."""
    if not len(same):
        return 0
    sums = np.cumsum(np.where(same, 1, -2))
    top = np.maximum.accumulate(np.maximum(sums, 0))
    stop = np.flatnonzero(top - sums >= 8)
    sums = sums[: stop[0]] if len(stop) else sums
    return int(sums.argmax()) + 1 if len(sums) and sums.max() > 0 else 0


def extend(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """Words of x and of y that go on matching from their starts, and matches:
    along a diagonal, and on to one up to four words off where eight words then
    match but for one."""
    i = j = hits = 0
    while True:
        m = min(len(x) - i, len(y) - j)
        same = x[i : i + m] == y[j : j + m]
        n = outwards(same)
        i, j, hits = i + n, j + n, hits + int(same[:n].sum())
        for a, b in ((1, 0), (0, 1), (2, 0), (0, 2), (3, 0), (0, 3), (4, 0), (0, 4)):
            u, v = x[i + a : i + a + 8], y[j + b : j + b + 8]
            if len(u) == len(v) == 8 and (u == v).sum() >= 7:
                i, j = i + a, j + b
                break
        else:
            return i, j, hits


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short runs of words."""
    row = np.zeros(len(b) + 1, np.int64)
    for v in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == v)))
    return int(row[-1])


def align(x: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, d: np.ndarray) -> list[tuple[int, int, float]]:
    """Pieces (first word, end word, identity) of x that a chain matches in y.
    x0, x1, d: its segments, with all places counted within x and y."""
    out: list[tuple[int, int, int]] = []  # first, end, matches
    last_x = last_y = None
    for a, z, e in zip(x0.tolist(), x1.tolist(), d.tolist()):
        if last_x is not None and (a < last_x or a - e < last_y):  # segments may share words
            a = max(a, last_x, last_y + e)
        if a >= z:
            continue
        hits = int((x[a:z] == y[a - e : z - e]).sum())
        if last_x is None:
            more, _, got = extend(x[:a][::-1], y[: a - e][::-1])
            out.append((a - more, z, got + hits))
        else:
            first, end, got = out[-1]
            between = common(x[last_x:a], y[last_y : a - e])
            if (between + hits) / max(z - last_x, z - e - last_y, 1) >= IDENTITY or (got + between + hits) / max(z - first, 1) >= IDENTITY:
                out[-1] = first, z, got + between + hits
            else:  # apart: both go on towards each other
                fore, _, more = extend(x[last_x:a], y[last_y : a - e])
                back, _, less = extend(x[last_x + fore : a][::-1], y[last_y : a - e][::-1])
                out[-1] = first, end + fore, got + more
                out.append((a - back, z, hits + less))
        last_x, last_y = z, z - e
    if last_x is not None:
        first, end, got = out[-1]
        more, _, hits = extend(x[last_x:], y[last_y:])
        out[-1] = first, end + more, got + hits
    return [(a, z, got / (z - a)) for a, z, got in out if z - a >= PIECE and got >= IDENTITY * (z - a)]


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, k: int = K, w: int = W) -> DataFrame:
    """doc_id, first_word, end_word, identity, kept_doc_ids, key: the passages
    of each document that documents with lesser keys have too; kept_doc_ids are
    those documents."""
    ship(docs.sparkSession)
    found = seeds(docs, id_col, text_col, k, w)
    found = staged(found.select("seed", "key", "x"), "seeds")
    place = F.struct("key", "x")
    anchors = found.groupBy("seed").agg(F.min(place).alias("a"), F.count("*").alias("n")).where("n > 1").select("seed", F.col("a.key").alias("anchor"), F.col("a.x").alias("y"))
    matches = found.join(anchors, "seed").where("key != anchor").select("key", "anchor", "x", "y")
    sorted_ = matches.repartition("key").sortWithinPartitions("key", "anchor", "x", "y")

    def link(batches):
        for t in whole_groups(batches, ["key"]):
            yield chains_of(t, k, w)

    chains = staged(sorted_.mapInArrow(link, CHAIN), "chains")
    unstage(found)
    texts = words(docs, id_col, text_col).groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("words").alias("words"))
    cut = lambda a, z: F.expr(f"substring(words, cast(2 * greatest({a} - {MARGIN}, 0) + 1 as int), cast(2 * ({z} + {MARGIN} - greatest({a} - {MARGIN}, 0)) as int))")
    left = chains.join(texts.withColumnRenamed("key", "anchor"), "anchor").select("key", "anchor", F.col("doc_id").alias("kept_doc_id"), "x0", "x1", "d", "xa", "xz", "ya", cut("ya", "yz").alias("there"))
    both = left.join(texts, "key").select("key", "doc_id", "kept_doc_id", "x0", "x1", "d", "xa", "ya", cut("xa", "xz").alias("here"), "there")
    kind = docs.schema[id_col].dataType.simpleString()

    def match(batches):
        for b in batches:
            names = b.schema.names
            col = {n: b.column(i) for i, n in enumerate(names)}
            at, out = [], []
            xa, ya = (np.maximum(col[n].to_numpy() - MARGIN, 0) for n in ("xa", "ya"))
            offsets = col["x0"].offsets.to_numpy()
            x0, x1, d = (col[n].values.to_numpy() for n in ("x0", "x1", "d"))
            here, there = col["here"], col["there"]
            for i in range(b.num_rows):
                s = slice(offsets[i], offsets[i + 1])
                x, y = (np.frombuffer(v[i].as_buffer(), np.uint16) for v in (here, there))
                for a, z, same in align(x, y, x0[s] - xa[i], x1[s] - xa[i], d[s] - xa[i] + ya[i]):
                    at.append(i)
                    out.append((a + xa[i], z + xa[i], same))
            take = pa.array(at, pa.int64())
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([*(col[n].take(take) for n in ("key", "doc_id", "kept_doc_id")), *(pa.array(c, kind_) for c, kind_ in zip(cols, [pa.int32(), pa.int32(), pa.float64()]))], names=["key", "doc_id", "kept_doc_id", "a", "z", "same"])

    pieces = both.mapInArrow(match, f"key long, doc_id {kind}, kept_doc_id {kind}, a int, z int, same double")

    def unite(batches):
        for t in whole_groups(batches, ["key"]):
            key, a, z, same = (t.column(n).to_numpy() for n in ("key", "a", "z", "same"))
            if not len(key):
                continue
            fresh = np.append(True, key[1:] != key[:-1])
            base = np.cumsum(fresh) * (int(z.max()) + 4)  # one line for all keys
            far = np.maximum.accumulate(z + base)
            new = np.append(True, a[1:] + base[1:] > far[:-1] + 2)
            first = np.flatnonzero(new)
            begin, end = a[first], far[np.append(first[1:], len(key)) - 1] - base[first]
            good = np.flatnonzero(end - begin >= least)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), t.column("kept_doc_id").combine_chunks() if isinstance(t.column("kept_doc_id"), pa.ChunkedArray) else t.column("kept_doc_id"))
            low = np.minimum.reduceat(same, first)
            take = pa.array(first[good])
            yield pa.RecordBatch.from_arrays([_flat(t.column("key")).take(take), _flat(t.column("doc_id")).take(take), pa.array(begin[good], pa.int32()), pa.array(end[good], pa.int32()), pa.array(low[good].round(4)), lists.take(pa.array(good))], names=["key", "doc_id", "first_word", "end_word", "identity", "kept_doc_ids"])

    united = pieces.repartition("key").sortWithinPartitions("key", "a", "z").mapInArrow(unite, f"key long, doc_id {kind}, first_word int, end_word int, identity double, kept_doc_ids array<{kind}>")
    return united.select("doc_id", "first_word", "end_word", "identity", F.array_sort(F.array_distinct("kept_doc_ids")).alias("kept_doc_ids"), "key")


def _flat(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, count_col: str = "n_chars") -> DataFrame:
    """docs, all columns, without the passages that passages() finds: from a
    passage's first word to the end of its last. A row of whose text nothing but
    space and punctuation remains goes. count_col, if it is a column of whole
    numbers, follows the length of a text that changes."""
    spans = passages(docs, id_col, text_col, least).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first_word", "end_word"))).alias("_spans"))
    spans = staged(spans.withColumnRenamed("key", "_key"), "spans")
    h1, _ = row_key(id_col, text_col)
    rows = docs.select(F.struct("*").alias("_row"), h1.alias("_key")).join(spans, "_key", "left").select("_row", "_spans")
    at = docs.columns.index(text_col)
    counted = docs.columns.index(count_col) if count_col in docs.columns and isinstance(docs.schema[count_col].dataType, (T.LongType, T.IntegerType)) else None

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                b = whole.slice(begin, 512)
                row = pa.RecordBatch.from_struct_array(b.column(0))
                some = np.flatnonzero(b.column(1).is_valid().to_numpy(zero_copy_only=False))
                changed: dict[int, str] = {}
                gone = np.zeros(b.num_rows, bool)
                if len(some):
                    texts = row.column(at).take(pa.array(some))
                    _, of, start, end = words_of(texts, lower=False)
                    first = np.searchsorted(of, np.arange(len(some) + 1))
                    base = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
                    for j, i in enumerate(some.tolist()):
                        raw, left, held = texts[j].as_py().encode(), 0, []
                        for span in b.column(1)[i].as_py():
                            held.append(raw[left : start[first[j] + span["first_word"]] - base[j]])
                            left = end[first[j] + span["end_word"] - 1] - base[j]
                        held.append(raw[left:])
                        cuts = sum(s["end_word"] - s["first_word"] for s in b.column(1)[i].as_py())
                        changed[i] = b"".join(held).decode()
                        gone[i] = cuts == first[j + 1] - first[j]
                done = edited(row, changed, at, counted).filter(pa.array(~gone))
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(done.columns, fields=list(done.schema))], names=["_row"])

    return rows.mapInArrow(run, T.StructType([T.StructField("_row", docs.schema)])).select("_row.*")
