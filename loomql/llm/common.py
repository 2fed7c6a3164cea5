"""What the training-data operators share: row keys, staged tables, word hashing."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers that may not have it on their path."""
    context = spark.sparkContext
    if getattr(context, "_loomql_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="loomql-code-")  # read by the driver alone, which serves it
    at = f"{folder}/loomql.zip"
    root = Path(__file__).resolve().parents[2]
    with zipfile.ZipFile(at, "w") as packed:
        for source in sorted((root / "loomql").rglob("*.py")):
            packed.write(source, source.relative_to(root))
    context.addPyFile(at)
    context._loomql_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's
    checkpoint folder. Only a local master, as in tests, gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    found = context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomql-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the
    lineage ends there, so a lost executor costs at most one stage. Shuffle files
    of the write go once it has ended, as nothing will read them again."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/loomql-{label}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    back = spark.read.schema(df.schema).parquet(path)
    back._loomql_path = path
    return back


def unstage(df: DataFrame) -> None:
    """Delete a table that staged() made, once nothing will read it again."""
    path, jvm = getattr(df, "_loomql_path", None), df.sparkSession._jvm
    if path:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000) -> Iterator[pa.Table]:
    """For mapInArrow over rows sorted by `keys`: tables of about `least` rows
    or more that hold whole groups of equal keys, equal rows side by side once."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = _unrepeated(batch)
        if rows >= least:
            new = np.zeros(batch.num_rows, bool)
            before = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1, 1), batch]).combine_chunks()
            for k in keys:
                column = before.column(k)
                new |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            if len(first):
                yield pa.Table.from_batches([*held, batch.slice(0, first[0])]).combine_chunks()
                batch, held, rows = batch.slice(first[0]), [], 0
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _unrepeated(batch: pa.RecordBatch) -> pa.RecordBatch:
    if batch.num_rows < 2:
        return batch
    differ = np.zeros(batch.num_rows - 1, bool)
    for column in batch.columns:
        if pa.types.is_integer(column.type) and not column.null_count:
            x = column.to_numpy()
            differ |= x[1:] != x[:-1]
        else:
            return batch
    return batch if differ.all() else batch.filter(pa.array(np.append(True, differ)))


def ranked(df: DataFrame, order: list[Column], key: str, label: str) -> DataFrame:
    """df with `part` and `rank`, staged: rows are spread by ranges of `order`,
    which starts with the long column `key`, and numbered within part and key.
    As `order` goes on beyond the key, a key that many rows hold is in many
    parts; there are at most parts + keys pairs of part and key."""

    def number(batches):
        at, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(b.schema.get_field_index(key)).to_numpy()
            new = np.append(x[0] != last, x[1:] != x[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(x)), -1))
            rank = np.arange(len(x)) - start
            rank[start < 0] = np.arange((start < 0).sum()) + seen
            last, seen = x[-1], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(x), at), pa.int32()), pa.array(rank, pa.int64())], names=[*b.schema.names, "part", "rank"])

    schema = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())])
    return staged(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema), label)


def filled(rows: DataFrame, runs: DataFrame, key: str, given: list[str]) -> DataFrame:
    """rows (of ranked()) with the columns `given` of the run that holds each:
    the last of its part and key that begins (`rank`) at or before its rank,
    and `ahead`, the rows from that begin. One shuffle by part; no join."""
    kinds = {f.name: f.dataType for f in runs.schema.fields}
    plain = [f for f in rows.schema.fields if f.name not in ("part", "rank", key)]
    both = rows.select("part", key, "rank", F.lit(True).alias("is_row"), *[f.name for f in plain], *[F.lit(None).cast(kinds[g]).alias(g) for g in given])
    both = both.unionByName(runs.select("part", key, "rank", F.lit(False).alias("is_row"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in plain], *given))

    def fill(batches):
        held, begin = None, 0  # values and begin of the last run
        for b in batches:
            if not b.num_rows:
                continue
            rank, is_row = b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
            last = np.maximum.accumulate(np.where(is_row, -1, np.arange(len(rank))))
            own = last >= 0
            ahead = rank - np.where(own, rank[last], begin)
            out = []
            for i, g in enumerate(given):
                x = b.column(b.schema.get_field_index(g)).fill_null(0).to_numpy()
                out.append(np.where(own, x[last], held[i] if held else 0))
            if own[-1]:
                held, begin = [x[-1] for x in out], int(rank[last[-1]])
            keep = pa.array(is_row)
            columns = [b.column(1), *b.columns[4 : 4 + len(plain)], *map(pa.array, out), pa.array(ahead)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=[key, *[f.name for f in plain], *given, "ahead"])

    schema = T.StructType([T.StructField(key, kinds[key]), *plain, *[T.StructField(g, kinds[g]) for g in given], T.StructField("ahead", T.LongType())])
    return both.repartition("part").sortWithinPartitions("part", key, "rank", "is_row").mapInArrow(fill, schema)


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits that name a row by id and text. Rows equal in both are the same
    document; a null id or text hashes like any other value."""
    doc_id, text = F.col(id_col), F.col(text_col)
    return (
        F.xxhash64(F.lit("a"), doc_id, doc_id.isNull(), text, text.isNull()),
        F.xxhash64(F.lit("b"), text, text.isNull(), doc_id, doc_id.isNull()),
    )


def arrow_rows(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable:
    """For mapInArrow: fn gets record batches of at most 512 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield from fn(batch.slice(at, 512))

    return run


WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[*b" \t\n\r\f\v\x1c\x1d\x1e\x1f", *b".,;:!?\"'()[]{}<>*#%&$/\\|`~^+=-"]] = False
_rng = np.random.Generator(np.random.PCG64(20_240_229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {"step": powers(STEP, 1 << 16), "back": powers(STEP_BACK, 1 << 16)}


def power(kind: str, n: int) -> np.ndarray:
    if len(_POWERS[kind]) < n:
        _POWERS[kind] = powers(STEP if kind == "step" else STEP_BACK, 2 * n)
    return _POWERS[kind][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return flat, offsets - (offsets[0] if len(offsets) else 0)


def words_of(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lower-cased texts of a column without nulls: the 64-bit hash, row,
    first byte and end byte (both counted within the batch) of each word, in
    order. Words are runs of bytes other than ASCII space and punctuation, the
    no-break space, general punctuation (U+2000 to U+206F) and that of CJK (U+3000
    to U+303F); a character of a script without spaces (CJK, kana, hangul, Thai,
    Lao) is a word. The hash is a polynomial over random byte codes, so any batch gives the same.
    Without `lower` the words are the same in number, their places those in the
    text as it is."""
    flat, offsets = utf8(pc.utf8_lower(column) if lower else column)
    if not len(flat):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    inside, alone = WORD_BYTE[flat], None
    if (flat >= 0xC2).any():
        padded = np.append(flat, np.zeros(2, np.uint8))
        lead = np.flatnonzero((flat == 0xC2) & (padded[1:-1] == 0xA0))
        for p in (lead, lead + 1):
            inside[p] = False
        three = np.flatnonzero(flat >= 0xE0)
        a, b = flat[three], padded[three + 1]
        for p in three[(a == 0xE2) & (b <= 0x81) | (a == 0xE3) & (b == 0x80)]:
            inside[p : p + 3] = False
        own = three[(a >= 0xE3) & (a <= 0xED) & ~((a == 0xE3) & (b == 0x80)) | (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)]
        if len(own):
            alone = np.zeros(len(flat) + 3, bool)
            alone[own] = alone[own + 3] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(flat)]
    before[cut] = False
    start = np.flatnonzero(inside & (~before if alone is None else ~before | alone[: len(flat)]))
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    end = np.flatnonzero(inside & (~after if alone is None else ~after | alone[1 : len(flat) + 1])) + 1
    value = np.zeros(len(flat) + 1, np.uint64)
    for at in range(0, len(flat), 1 << 15):  # within a block of bytes the powers stay in cache
        piece = flat[at : at + (1 << 15)]
        np.cumsum(BYTE_CODE[piece] * power("step", len(piece)), out=value[at + 1 : at + 1 + len(piece)])
    base = start >> 15
    low = value[start] * ((start & 0x7FFF) != 0)
    whole = (end - 1) >> 15 == base
    sums = (value[end] - low) * power("back", 1 << 15)[start & 0x7FFF]
    for i in np.flatnonzero(~whole):  # words across a block border
        s, e = int(start[i]), int(end[i])
        sums[i] = (BYTE_CODE[flat[s:e]] * power("step", e - s)).sum(dtype=np.uint64)
    return mix(sums + (end - start).astype(np.uint64)), np.searchsorted(offsets, start, side="right") - 1, start, end
