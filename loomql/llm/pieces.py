"""Operator 4. Sampled SentencePiece encoding, and decoding without loss.

The piece lattice of a text has an edge for every vocabulary piece at every
place, and byte edges for characters that are no piece. An edge of a piece
weighs (rank + 1) ** -alpha. Forward filtering sums the weights of all paths to
each place; backward sampling then draws edges from the end. Random numbers are
a hash of (seed, row key, place in the text), so a row's segmentation is the
same in any batch, partition or retry.

The lattice is cut wherever two neighbouring bytes are adjacent in no piece: no
edge crosses such a place, so the parts are independent and equal parts of a
batch share their sums. A space is the piece mark; a literal mark in the text
becomes byte pieces, and one space put in front is taken off when decoding, so
decode(encode(x)) == x for every x.

Equal parts are known by a 64-bit hash; what is drawn is compared with the bytes
of the text, and a row that differs, as two parts met in one hash, is drawn again
from sums of its own.

Cases. A null text gives null ids; an empty one no ids. A null row key hashes
like any other value; rows equal in key and text get equal ids. A long part (a
run without a cut, LONG bytes or more) has sums of its own, of the same edges; a
very long text is done in slices between cuts. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomql.llm.common import mix, ship, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
LONG = 64  # bytes; longer parts are summed one by one, in logarithms
SLICE = 1 << 21  # bytes of text at once
KEPT = 1_500_000  # places of parts whose sums are kept from batch to batch
GOLD = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    def __init__(self, model: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        if n > np.iinfo(np.int16).max:
            raise ValueError(f"{model}: {n} pieces; the tables hold ids of 16 bits")
        self.byte_ids = np.full(256, -1, np.int32)
        self.text: list[bytes] = [b""] * n
        normal = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.text[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.text[i] = piece.replace("▁", " ").encode()
                normal.append(i)
        self.most = max(len(self.text[i]) for i in normal)
        self.near = np.zeros((256, 256), bool)
        weight = np.zeros(n)
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for rank, i in enumerate(normal):
            weight[i] = (rank + 1.0) ** -alpha
            node, raw = 0, self.text[i]
            for b in reversed(raw):
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][b]
            ends[node] = i
            for a, b in zip(raw, raw[1:]):
                self.near[a, b] = True
        weight[self.byte_ids[self.byte_ids >= 0]] = (len(normal) + 1.0) ** -alpha
        self.weight, self.ends = weight, np.array(ends, np.int32)
        self.trie = np.zeros((len(children), 256), np.int32)
        for node, kids in enumerate(children):
            for b, kid in kids.items():
                self.trie[node, b] = kid
        self.single = {raw for raw in self.text if raw and (raw[0] >= 0xC0 or len(raw) == 1)} - {self.text[i] for i in self.byte_ids if i >= 0} | {self.text[i] for i in normal}
        self.sizes = np.array([len(x) for x in self.text], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        #: per byte, so that sums over long parts stay in range; cancels in every ratio
        self.scale = 12.0
        self._forget()

    def _forget(self) -> None:
        self.keys, self.spots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.sums = np.empty((0, 1), np.int16), np.empty((0, 1), np.float32)

    def _known(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where in self.ids and self.sums the last byte of each part is; adds
        parts that are new. Parts are known by 64-bit hash of bytes and length.
        Beyond KEPT places all are forgotten, which changes no result."""
        if len(self.ids) > KEPT:
            self._forget()
        key = self._hash(data, start, size)
        unique, sample, which = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != unique[inside]
        if new.any():
            s, z = start[sample[new]], size[sample[new]]
            ids, sums = self.forward(data, s, z)
            width = max(ids.shape[1], self.ids.shape[1])
            wide = lambda m, v: m if m.shape[1] == width else np.concatenate([m, np.full((len(m), width - m.shape[1]), v, m.dtype)], axis=1)
            last = len(self.ids) + np.cumsum(z) - 1
            self.ids = np.concatenate([wide(self.ids, -1), wide(ids, -1)])
            self.sums = np.concatenate([wide(self.sums, np.inf), wide(sums, np.inf)])
            keys, spots = np.concatenate([self.keys, unique[new]]), np.concatenate([self.spots, last])
            order = np.argsort(keys, kind="stable")
            self.keys, self.spots = keys[order], spots[order]
            at = np.searchsorted(self.keys, unique)
        return self.spots[at][which]

    def forward(self, data: np.ndarray, s: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward filtering of the parts at s of z bytes: for each byte, by
        length, the piece ids and running probabilities of the edges ending
        there (infinite from the last one on)."""
        first = np.concatenate([[0], np.cumsum(z)])
        within = np.arange(first[-1]) - np.repeat(first[:-1], z) + 1
        flat = data[np.repeat(s, z) + within - 1]
        ids, weight = self.edges(flat, within)
        width = ids.shape[1]
        total = np.ones(first[-1] + len(z))  # a part's places, and one before its first
        spot = np.arange(first[-1]) + np.repeat(np.arange(len(z)), z) + 1
        order = np.argsort(within.astype(np.int16), kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(within)[1:])])
        for t in range(1, len(bounds)):
            e = order[bounds[t - 1] : bounds[t]]
            k = min(t, width)
            w = weight[e, :k]
            w *= total[spot[e, None] - np.arange(1, k + 1)]
            np.cumsum(w, axis=1, out=w)
            total[spot[e]] = w[:, -1]
            weight[e, :k] = w
        ends = total[spot]  # 0 inside a character that is a piece: no edge ends there, none is asked for
        sums = (weight / np.where(ends > 0, ends, 1.0)[:, None]).astype(np.float32)
        deep = np.arange(1, width + 1)
        last = np.where(ids >= 0, deep, 0).max(axis=1)
        sums[deep >= last[:, None]] = np.inf
        return ids, sums

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First bytes of the independent parts."""
        head = (data & 0xC0) != 0x80
        cut = np.empty(len(data), bool)
        cut[0] = True
        cut[1:] = head[1:] & ~self.near[data[:-1], data[1:]]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        return np.flatnonzero(cut)

    def edges(self, data: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[places, most] piece ids (-1: none) and weights of the edges that end
        after each byte, by length; within: bytes since the part's start, plus 1."""
        n = len(data)
        ids = np.full((n, self.most), -1, np.int16)
        at, node, deepest = np.arange(n), np.zeros(n, np.int32), 1
        for d in range(self.most):
            m = within[at] > d
            at, node = at[m], node[m]
            node = self.trie[node, data[at - d]]
            m = node > 0
            at, node = at[m], node[m]
            if not len(at):
                break
            ids[at, d] = self.ends[node]
            deepest = d + 1
        head = (data & 0xC0) != 0x80
        first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        size = np.zeros(n, np.int64)
        last = np.append(head[1:], True)
        size[last] = np.arange(n)[last] - first[last] + 1
        known = np.zeros(n, bool)
        tail = np.flatnonzero(last)
        known[tail] = ids[tail, np.minimum(size[tail], self.most) - 1] >= 0
        bare = np.flatnonzero(~known[tail][np.cumsum(np.append(False, last[:-1]))])
        ids[bare, 0] = self.byte_ids[data[bare]]
        ids = ids[:, : deepest]
        weight = self.weight[ids] * self.scale ** np.arange(1, deepest + 1)
        weight[ids < 0] = 0.0
        return ids, weight

    def encode(self, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and each row's count. Every row
        that isn't empty starts with the space put in front."""
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        start = self.cuts(data, offsets)
        end = np.append(start[1:], len(data))
        size = end - start
        row = np.searchsorted(offsets, start, side="right") - 1
        seed, base = seeds[row], (start - offsets[row]).astype(np.uint64)
        short = np.flatnonzero(size <= LONG)
        pieces = np.zeros(len(start), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(short):
            at = self._known(data, start[short], size[short])  # the place after each part's last edge
            lead, live, step = at - size[short] + 1, np.arange(len(short)), 0
            seed, base = seed[short], base[short]
            while len(live):
                here = at[live]
                u = mix(seed[live] + (base[live] + (here - lead[live]).astype(np.uint64) + np.uint64(1)) * GOLD)
                u = ((u >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24))[:, None]
                d = (self.sums[here] <= u).sum(axis=1)
                found.append((short[live], np.full(len(live), step), self.ids[here, d]))
                at[live] = here - d - 1
                step += 1
                pieces[short[live]] += 1
                live = live[at[live] >= lead[live]]
        for i in np.flatnonzero(size > LONG):
            got = self._long(data[start[i] : end[i]], int(seeds[row[i]]), int(start[i] - offsets[row[i]]))
            pieces[i] = len(got)
            found.append((np.full(len(got), i), np.arange(len(got)), np.array(got, np.int32)))
        to = np.cumsum(pieces)
        out = np.empty(to[-1], np.int32)
        for i, k, ids in found:
            out[to[i] - 1 - k] = ids
        counts = np.bincount(row, weights=pieces, minlength=len(offsets) - 1).astype(np.int64)
        if not self.spells(out, data):
            if len(offsets) > 2:
                each = [self.encode(data[a:b], np.array([0, b - a]), seeds[i : i + 1]) for i, (a, b) in enumerate(zip(offsets, offsets[1:]))]
                return np.concatenate([x for x, _ in each]), np.concatenate([n for _, n in each])
            base = lambda i: int(start[i] - offsets[row[i]])
            own = [self._long(data[start[i] : end[i]], int(seeds[row[i]]), base(i))[::-1] for i in range(len(start))]
            out, counts = np.array(sum(own, []), np.int32), np.array([sum(map(len, own))])
        return out, counts

    def spells(self, ids: np.ndarray, data: np.ndarray) -> bool:
        """Whether the bytes of the pieces are those of the text."""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        if ends[-1] != len(data):
            return False
        flat = self.flat[np.repeat(self.firsts[ids] - (ends - size), size) + np.arange(len(data))]
        return np.array_equal(flat, data)

    @staticmethod
    def _hash(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each part of at most LONG bytes: eight at a time."""
        padded = np.concatenate([data, np.zeros(LONG + 8, np.uint8)])
        out = size.astype(np.uint64) * GOLD
        live = np.arange(len(start))
        for at in range(0, LONG, 8):
            live = live[size[live] > at]
            if not len(live):
                break
            eight = padded[start[live, None] + at + np.arange(8)].view(np.uint64).ravel()
            left = np.minimum(size[live] - at, 8).astype(np.uint64) * np.uint64(8)
            eight = np.where(left == 64, eight, eight & ((np.uint64(1) << (left % np.uint64(64))) - np.uint64(1)))
            out[live] = mix(out[live] ^ mix(eight + np.uint64(at)))
        return out

    def _long(self, data: np.ndarray, seed: int, base: int) -> list[int]:
        """The same for one long part, in logarithms; ids from last to first."""
        raw = data.tobytes()
        n = len(raw)
        total = [0.0] + [-math.inf] * n
        into: list[list[tuple[float, int, int]]] = [[] for _ in range(n + 1)]
        chars = raw.decode("utf-8", "surrogatepass")
        bare = [False] * n
        at = 0
        for ch in chars:
            b = ch.encode("utf-8", "surrogatepass")
            if b not in self.single:
                bare[at : at + len(b)] = [True] * len(b)
            at += len(b)
        trie, log_scale = self.trie, math.log(self.scale)
        for j in range(1, n + 1):
            node, edges = 0, []
            for d in range(1, min(self.most, j) + 1):
                node = int(trie[node, raw[j - d]])
                if not node:
                    break
                if self.ends[node] >= 0:
                    edges.append((d, int(self.ends[node])))
            if bare[j - 1]:
                edges.insert(0, (1, int(self.byte_ids[raw[j - 1]])))
            logs = [(total[j - d] + math.log(self.weight[i]) + d * log_scale, d, i) for d, i in edges]
            top = max((x for x, _, _ in logs), default=-math.inf)  # none ends inside a character that is a piece
            if top == -math.inf:
                continue
            run = 0.0
            for x, d, i in logs:
                run += math.exp(x - top) if x > -math.inf else 0.0
                into[j].append((run, d, i))
            total[j] = top + math.log(run)
        out, j = [], n
        while j:
            u = int(mix(np.array([(seed + (base + j) * int(GOLD)) % 2**64], np.uint64))[0]) >> 40
            u *= 2.0**-24 * into[j][-1][0]
            d, i = next(((d, i) for run, d, i in into[j] if run > u), into[j][-1][1:])
            out.append(i)
            j -= d
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(self.text[i] for i in ids)
        return raw[1:].decode("utf-8", "surrogatepass")


@cache
def lattice(model: str, alpha: float) -> Lattice:
    return Lattice(model, alpha)


def encode_column(model: str, alpha: float, text: pa.Array, seeds: np.ndarray) -> pa.Array:
    """ids of each text; slices of about SLICE bytes bound the memory, and a
    longer text is cut at a place that no piece crosses."""
    la = lattice(model, alpha)
    null = text.is_null().to_numpy(zero_copy_only=False)
    flat, offsets = utf8(text.fill_null(""))
    size = np.diff(offsets)
    counts, found = np.zeros(len(text), np.int64), []
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
        filled = np.flatnonzero(size[i:j] > 0) + i
        if len(filled):
            first = np.concatenate([[0], np.cumsum(size[filled] + 1)])
            data = np.full(first[-1], 32, np.uint8)
            mask = np.ones(first[-1], bool)
            mask[first[:-1]] = False
            data[mask] = flat[offsets[i] : offsets[j]]
            if len(filled) == 1 and len(data) > 2 * SLICE:
                ids, n = _very_long(la, data, seeds[filled])
            else:
                ids, n = la.encode(data, first, seeds[filled])
            counts[filled] = n
            found.append(ids)
        i = j
    values = np.concatenate(found) if found else np.empty(0, np.int32)
    ends = np.concatenate([[0], np.cumsum(counts)])
    made = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(values, pa.int32()))
    if null.any():
        made = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64(), mask=np.append(null, False)), pa.array(values, pa.int32()))
    return made.cast(pa.list_(pa.int32()))


def _very_long(la: Lattice, data: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.append(la.cuts(data, np.array([0, len(data)])), len(data))
    found, a = [], 0
    while a < len(data):
        k = int(np.searchsorted(cut, a + SLICE))
        b = int(cut[min(k, len(cut) - 1)])
        # places count from the start of the whole text
        ids, _ = la.encode(data[a:b], np.array([0, b - a]), seed.astype(np.uint64) + np.uint64(a * int(GOLD) % 2**64))
        found.append(ids)
        a = b
    ids = np.concatenate(found)
    return ids, np.array([len(ids)])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """doc_id, ids: one sampled segmentation of each row's text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(id_col).isNull()).alias("key"), F.col(text_col).alias("text"))
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                seeds = b.column(1).to_numpy().view(np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0), encode_column(model, alpha, b.column(2), seeds)], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text: the very texts that were encoded."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        la = lattice(model, ALPHA)
        for b in batches:
            text = [None if x is None else la.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
