"""Operator 2. Language identification by fusing evidence, as Bayes has it.

posterior(l) ~ prior(l | host) * P(declared | l) * P(address suffix | l)
               * P(text | l) ** TEMPER

Text: a multinomial over hashed byte trigrams of the lower-cased letters of the
whole text, against `und`, which holds every trigram equally likely. Neighbouring
trigrams share bytes, so their product is tempered.
Declared markup language: how often rows whose text reads as l declare d, over
the whole table, smoothed. Codes outside the trained languages count as one.
Address suffix: a national suffix names its language with SUFFIX_TRUST.
Host prior: counts of the text's readings by host, over the whole table, smoothed
towards those of the host's domain, and these towards those of all rows: grouped
aggregations of counts, never gathered rows. Priors join as a table; Spark
broadcasts it only if its size on disk is within the session's threshold.

Trigrams are learnt from labelled rows: about `train_rows` of each language at
most (documented bound), drawn with a fixed seed; all else covers every row. The
64 most frequent labels are languages.

A row is accepted if a trained language leads with `least` posterior. Cases. Null
and empty texts and texts without letters have no text evidence and are rejected,
their language read from the rest. A null host, address or declaration is no
evidence. Repeated rows are read alike. Ties go to the first language by name.
Without labelled rows all is `und`. An empty table gives no rows. Other columns,
also of clashing names, are kept by keep() and ignored by identify().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomql.llm.common import ship, staged, utf8

BUCKETS = 1 << 15
TEMPER = 1 / 3
TRAIN_ROWS = 1500
LEAST = 0.5
STRENGTH = 20.0  # rows that a parent's shares count for
SUFFIX_TRUST = 0.9
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en"}
SLICE = 1 << 21
LETTER = np.full(256, 32, np.uint32)
LETTER[97:123] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


def trigrams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of a column without nulls, and where each row's
    begin. Those around a space are left out, but for that of a word's end."""
    flat, offsets = utf8(pc.utf8_lower(text))
    x = np.full(len(flat) + len(text) + 2, 32, np.uint32)
    row = np.repeat(np.arange(len(text)), np.diff(offsets))
    x[np.arange(len(flat)) + row + 1] = LETTER[flat]  # a space before each text
    keep = np.flatnonzero(x[1:-1] != 32)
    code = (x[keep] << np.uint32(16)) | (x[keep + 1] << np.uint32(8)) | x[keep + 2]
    return (code * np.uint32(2_654_435_769)) >> np.uint32(17), np.searchsorted(keep, offsets + np.arange(len(offsets)))


def slices(text: pa.Array):
    """Ranges of rows of about SLICE bytes each."""
    size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    ends, i = np.cumsum(size), 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE, side="right")))
        yield i, j
        i = j


def train(docs: DataFrame, text_col: str, label_col: str, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and logarithms of P(trigram | language) [BUCKETS, languages + 1],
    the last being `und`. At most (languages * BUCKETS) sums reach the driver."""
    ship(docs.sparkSession)
    label = F.lower(F.trim(F.col(label_col)))
    rows = docs.select(label.alias("label"), F.col(text_col).alias("text")).where("label != '' and length(text) > 0")
    sizes = dict(sorted((r["label"], r["n"]) for r in rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(64).collect()))
    names = list(sizes)
    table = np.full((BUCKETS, len(names) + 1), -math.log(BUCKETS))
    if not names:
        return names, table
    chance = F.rand(7)  # by place, not by text, so that copies of one text count as rows
    chosen = F.lit(False)
    for k, n in sizes.items():
        chosen |= (F.col("label") == k) & (chance < train_rows / n)
    at = {k: i for i, k in enumerate(names)}

    def count(batches):
        sums = np.zeros((len(names), BUCKETS), np.int64)
        for b in batches:
            which = np.array([at[x] for x in b.column(0).to_pylist()], np.int64)
            for i, j in slices(b.column(1)):
                bucket, first = trigrams(b.column(1).slice(i, j - i))
                of = np.repeat(which[i:j], np.diff(first)) * BUCKETS + bucket
                sums += np.bincount(of, minlength=sums.size).reshape(sums.shape)
        a, c = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(c, pa.int32()), pa.array(sums[a, c])], names=["a", "c", "n"])

    got = rows.where(chosen).mapInArrow(count, "a int, c int, n long").groupBy("a", "c").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(names)))
    counts[got["c"], got["a"]] = got["n"]
    table[:, :-1] = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS))
    return names, table


def text_evidence(table: np.ndarray, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """[rows, languages + 1] tempered log likelihoods, and trigrams of each row."""
    text = text.fill_null("")
    out, n = np.zeros((len(text), table.shape[1])), np.zeros(len(text), np.int64)
    for i, j in slices(text):
        bucket, first = trigrams(text.slice(i, j - i))
        n[i:j] = np.diff(first)
        some = np.flatnonzero(n[i:j])
        if len(some):
            out[i + some] = np.add.reduceat(table[bucket], first[some], axis=0) * TEMPER
    return out, n


def parts_of(host: Column | None, address: Column | None) -> tuple[Column, Column, Column]:
    """suffix, domain and host of a row, from its address or its named host."""
    if address is not None:
        host = F.lower(F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]+)", 1))
    if host is None:
        host = F.lit(None).cast("string")
    host = F.when(host != "", host)
    suffix = F.when(host.contains("."), F.element_at(F.split(host, r"\."), -1))
    domain = F.when(host.contains("."), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).otherwise(host)
    return suffix, domain, host


class Model:
    """What is learnt from a whole table: trigrams, declarations, host priors."""

    def __init__(self, names: list[str], table: np.ndarray, declared: np.ndarray, priors: DataFrame, base: np.ndarray):
        self.names, self.table, self.declared, self.priors, self.base = names, table, declared, priors, base


def columns_of(docs: DataFrame, text: Column, declared: Column | None, host: Column | None, address: Column | None, names: list[str], *more: Column) -> DataFrame:
    suffix, domain, host = parts_of(host, address)
    code = F.lower(F.substring_index(F.substring_index(F.trim(declared), "-", 1), "_", 1)) if declared is not None else F.lit(None).cast("string")
    index = F.lit(len(names))
    own = F.lit(-1)
    for i, k in enumerate(names):
        index = F.when(code == k, i).otherwise(index)
        own = F.when(suffix.isin([s for s, lang in SUFFIXES.items() if lang == k] or [""]), i).otherwise(own)
    declared_index = F.when(code.isNull() | (code == ""), -1).otherwise(index)
    return docs.select(*more, text.alias("_text"), declared_index.cast("int").alias("_declared"), own.cast("int").alias("_suffix"), domain.alias("_domain"), host.alias("_host"))


def fit(docs: DataFrame, labelled: DataFrame, text: Column, declared: Column | None = None, host: Column | None = None, address: Column | None = None, label_col: str = "lang", label_text: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    names, table = train(labelled, label_text, label_col, train_rows)
    n = len(names)

    def read(batches):
        for b in batches:
            got, size = text_evidence(table, b.column(0))
            best = np.where(size > 0, got.argmax(axis=1), n).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(best)], names=["_declared", "_suffix", "_domain", "_host", "_best"])

    rows = columns_of(docs, text, declared, host, address, names).mapInArrow(read, "_declared int, _suffix int, _domain string, _host string, _best int")
    counts = staged(rows.groupBy("_declared", "_domain", "_host", "_best").agg(F.count("*").alias("n")).where(f"_best < {n}"), "readings")
    seen = np.ones((n + 1, n))  # declared, language: one row each beforehand
    base = np.ones(n)
    for r in counts.groupBy("_declared", "_best").agg(F.sum("n").alias("n")).collect():  # (n + 2) * n rows at most
        base[r["_best"]] += r["n"]
        if r["_declared"] >= 0:
            seen[r["_declared"], r["_best"]] += r["n"]
    shares = base / base.sum()
    each = [F.sum(F.when(F.col("_best") == i, F.col("n")).otherwise(0)).cast("double").alias(f"n{i}") for i in range(n)]
    total = lambda: sum((F.col(f"n{i}") for i in range(n)), F.lit(0.0))
    smooth = lambda i, parent: ((F.col(f"n{i}") + STRENGTH * parent) / (total() + STRENGTH)).alias(f"p{i}")
    if not n:
        none = docs.sparkSession.createDataFrame([], "_host string, _prior array<double>")
        return Model(names, table, seen, none, shares)
    domains = counts.where("_domain is not null").groupBy("_domain").agg(*each).select("_domain", *[smooth(i, F.lit(float(shares[i]))) for i in range(n)])
    hosts = counts.where("_host is not null").groupBy("_domain", "_host").agg(*each)
    hosts = hosts.join(domains, "_domain").select("_host", F.array(*[F.log(smooth(i, F.col(f"p{i}"))) for i in range(n)]).cast("array<double>").alias("_prior"))
    return Model(names, table, np.log(seen / seen.sum(axis=0)), staged(hosts, "priors"), np.log(shares))


def decide(model: Model, text: pa.Array, declared: np.ndarray, suffix: np.ndarray, prior: pa.Array, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the leading language, its posterior, and whether it's accepted."""
    n = len(model.names)
    log, size = text_evidence(model.table, text)
    given = np.tile(model.base, (len(text), 1))
    some = prior.is_valid().to_numpy(zero_copy_only=False)
    if some.any():
        given[some] = prior.drop_null().flatten().to_numpy().reshape(-1, n)
    log[:, :n] += given
    own = np.flatnonzero(declared >= 0)
    log[own, :n] += model.declared[declared[own]]
    named = np.flatnonzero(suffix >= 0)
    if len(named):
        log[named, :n] += np.log((1 - SUFFIX_TRUST) / max(1, n - 1))
        log[named, suffix[named]] += np.log(SUFFIX_TRUST) - np.log((1 - SUFFIX_TRUST) / max(1, n - 1))
    log[:, n] += math.log(0.01)  # the prior of und, and of any declaration under it
    log[own, n] -= math.log(n + 1)
    if n:
        log[size == 0, n] = -np.inf
    best = log.argmax(axis=1)
    top = log[np.arange(len(text)), best]
    posterior = 1 / np.exp(log - top[:, None]).sum(axis=1)
    return best, posterior, (best < n) & (posterior >= least) & (size > 0)


def identify(docs: DataFrame, model: Model, text: Column, declared: Column | None = None, host: Column | None = None, address: Column | None = None, id_col: str = "doc_id", least: float = LEAST) -> DataFrame:
    """doc_id, language, posterior, accepted of every row."""
    rows = columns_of(docs, text, declared, host, address, model.names, F.col(id_col).alias("doc_id")).join(model.priors, "_host", "left")
    rows = rows.select("doc_id", "_text", "_declared", "_suffix", "_prior")
    names = pa.array([*model.names, "und"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    fixed = _light(model)

    def run(batches):
        for b in batches:
            best, posterior, ok = decide(fixed, b.column(1), b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4), least)
            yield pa.RecordBatch.from_arrays([b.column(0), names.take(pa.array(best)), pa.array(posterior.round(6)), pa.array(ok)], names=["doc_id", "language", "posterior", "accepted"])

    return rows.mapInArrow(run, f"doc_id {kind}, language string, posterior double, accepted boolean")


def keep(docs: DataFrame, model: Model, text_col: str = "text", declared: Column | None = None, host: Column | None = None, address: Column | None = None, least: float = LEAST) -> DataFrame:
    """The accepted rows of docs, all columns."""
    rows = columns_of(docs, F.lit(0), declared, host, address, model.names, F.struct("*").alias("_row")).join(model.priors, "_host", "left")
    rows = rows.select("_row", "_declared", "_suffix", "_prior")
    at, fixed = docs.columns.index(text_col), _light(model)

    def run(batches):
        for b in batches:
            _, _, ok = decide(fixed, b.column(0).field(at), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3), least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok))], names=["_row"])

    schema = T.StructType([T.StructField("_row", docs.schema)])
    return rows.mapInArrow(run, schema).select("_row.*")


def _light(model: Model) -> Model:
    """Without the table of priors, which a task can't hold."""
    return Model(model.names, model.table, model.declared, None, model.base)
