"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (as JSON text) up to which a lookup side may be broadcast; beyond them the join shuffles.
BROADCAST_ROWS = 250_000
BROADCAST_BYTES = 32_000_000
#: Rows of one key that may meet in a shuffled join, and the most keys that can be heavier where there are many rows.
HEAVY_ROWS = 128
HEAVY_KEYS = 100_000
#: 64-bit words of the table that tells which rows may have a partner.
MARK_WORDS = 131_072
#: Spark's setting by which an execution deletes its shuffle files at its end.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that a task turns into arrays at once.
CHUNK_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where that setting is
    absent a local session uses a folder below the warehouse, and a cluster is refused."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_letterlake_shared"


def _tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/letterlake-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    The shuffle files of the write go when it has ended, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{_tables_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    for paths in _SCRATCH.get():
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._letterlake_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: The tables that each open ``scratch`` has seen.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("letterlake_scratch", default=())


@contextmanager
def scratch(spark: SparkSession, keep: list[DataFrame]) -> Iterator[None]:
    """Delete at its end the tables that were materialised within, but for those in ``keep`` by then."""
    paths: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), paths))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        kept = {getattr(df, "_letterlake_path", None) for df in keep}
        for path in paths:
            if path not in kept:
                _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    path = getattr(df, "_letterlake_path", None)
    if path:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has materialised; results that still read them break."""
    _delete(spark, _tables_dir(spark))


def is_small(df: DataFrame) -> bool:
    rows, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is within ``BROADCAST_ROWS`` and ``BROADCAST_BYTES``, else as it is (shuffled join)."""
    return F.broadcast(df) if is_small(df) else df


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner", wide: bool = False) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key and in ``weight`` how many rows have it.

    ``total`` is the sum of the weights, so ``table`` has no more rows than that: within
    ``BROADCAST_ROWS`` it is broadcast as it is, unless its rows are ``wide``.  Beyond, a key of more rows than ``HEAVY_ROWS`` (or, with many rows, than their 100,000th part) is dealt
    out over as many partitions as it needs; its table row goes to each of them.  The heavy keys are
    broadcast: their weights add up to at most ``total``, so there are at most ``HEAVY_KEYS``.
    """
    if total <= BROADCAST_ROWS and not wide:
        return rows.join(F.broadcast(table.drop(weight)), keys, how)
    most = max(HEAVY_ROWS, -(-total // HEAVY_KEYS))
    parts = F.ceil(F.col(weight) / most).cast("int")
    heavy = table.where(F.col(weight) > most).select(*keys, parts.alias("__parts"))
    salt = F.pmod(F.xxhash64(*rows.columns), F.coalesce("__parts", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(heavy), keys, "left").withColumn("__salt", salt).drop("__parts")
    copies = F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))
    return dealt.join(table.withColumn("__salt", copies).drop(weight), [*keys, "__salt"], how).drop("__salt")


def marked(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``__maybe``: false only where ``table`` certainly does not have their ``key`` (a column of hashes, of both).

    One bit for each key of ``table``, in ``MARK_WORDS`` words that are broadcast: with a million keys 11 % of other
    rows are marked too, and more keys mark more.  It saves the shuffle of rows without partners; the join decides.
    """
    word, bit = F.pmod(F.col(key), F.lit(MARK_WORDS)).cast("int"), F.pmod(F.shiftright(key, 32), F.lit(64)).cast("int")
    bits = table.select(word.alias("__mark_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__mark_bits"))
    bits = bits.groupBy("__mark_word").agg(F.bit_or("__mark_bits").alias("__mark_bits"))
    found = rows.join(F.broadcast(bits), word == F.col("__mark_word"), "left")
    return found.withColumn("__maybe", F.coalesce(F.call_function("bit_get", "__mark_bits", bit) == 1, F.lit(False))).drop("__mark_word", "__mark_bits")


def without(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of ``df`` that a result with columns ``names`` does not replace."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


# --- text as numpy arrays -------------------------------------------------------------------

#: Byte -> lower-cased byte of a word, or 0 between words: ASCII digits, letters, all of UTF-8 beyond ASCII.
FOLD = np.zeros(256, np.uint8)
FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    _, places, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        sizes = np.diff(offsets)
        if (sizes[np.asarray(column.is_null())] > 0).any():
            return utf8(column.fill_null(""))
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row stands alone, whole."""
    _, offsets = utf8(column)
    n, lo = len(column), 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


class Words:
    """The words of some rows: maximal runs of word bytes, A-Z lower-cased.

    ``array`` holds them in order, ``bounds[i]:bounds[i + 1]`` are the words of row ``i``.
    """

    def __init__(self, column: pa.Array):
        data, offsets = utf8(column)
        folded = FOLD[data]
        inside = folded != 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & ~(before & ~edge[:-1]))
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
        places = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=places[1:])
        self.starts, self.ends = starts, ends
        self.bounds = np.searchsorted(starts, offsets).astype(np.int64)
        self.array = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(folded[inside]))

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def string_words(text: str) -> list[str]:
    """The words of one text, as in ``Words``."""
    return Words(pa.array([text], pa.string())).array.to_pylist()


def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    """A list column with ``counts[i]`` of the values in row ``i``."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
