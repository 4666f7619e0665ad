"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The benchmark's windows (``window`` consecutive words; a shorter item is one window) are the
patterns.  For each pattern length there is a shift table indexed by a hash of ``block``
consecutive words: the text pointer jumps over positions where no pattern can end.  Where the
shift is zero, the suffix-hash bucket gives the patterns to test, and their words are compared
one by one.  Words are numbers of the patterns' vocabulary, found by exact comparison, so a hit
is never a hash collision.

Spark deals out the documents; no shuffle takes place.  The benchmark is broadcast in blocks of
about ``block_bytes`` text bytes, each as its coded words and the places of its windows, built in
time linear in the block but for sorting; each block is one more pass over the same partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterlake.llm.common import Words, chunks, lists, string_words, without

#: Text bytes of the benchmark that are broadcast at once.
BLOCK_BYTES = 16_000_000
#: Window starts that one lane of the search covers.
LANE = 256


class Patterns:
    """Shift table and buckets for patterns of one length (word numbers)."""

    def __init__(self, windows: np.ndarray, block: int = 3, bits: int = 0, codes: np.ndarray | None = None, at: np.ndarray | None = None):
        """``windows`` are kept as places ``at`` in ``codes`` where those are given."""
        count, self.length = windows.shape
        self.codes = windows.ravel() if codes is None else codes
        self.at = np.arange(count) * self.length if at is None else at
        self.block = min(block, self.length)
        # some slots per window, so that small tables stay small and large ones selective
        self.bits = bits or min(24, max(10, (4 * count).bit_length()))
        self.beyond = self.length - self.block + 1
        self.shift = np.full(1 << self.bits, self.beyond, np.int32)
        for at_ in range(self.beyond):
            slots = self.slots(windows[:, at_ : at_ + self.block])
            np.minimum.at(self.shift, slots, self.length - self.block - at_)
        suffix = self.slots(windows[:, -self.block :])
        self.order = np.argsort(suffix, kind="stable")
        self.bucket = np.searchsorted(suffix[self.order], np.arange((1 << self.bits) + 1))

    def slots(self, blocks: np.ndarray) -> np.ndarray:
        mixed = np.zeros(len(blocks), np.uint64)
        for k in range(blocks.shape[1]):
            mixed = (mixed ^ blocks[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and patterns of all occurrences that lie within one row each."""
        first, last = bounds[:-1], bounds[1:] - self.length + 1
        keep = last > first
        first, last = first[keep], last[keep]
        parts = -(-(last - first) // LANE)
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at = np.repeat(first, parts) + nth * LANE
        end = np.minimum(at + LANE, np.repeat(last, parts))
        tail = self.length - self.block
        found_at, found_slot = [], []
        while len(at):
            words = ids[at[:, None] + tail + np.arange(self.block)]
            known = (words >= 0).all(axis=1)
            slots = self.slots(words)
            jump = np.where(known, self.shift[slots], self.beyond)
            hit = jump == 0
            if hit.any():
                found_at.append(at[hit])
                found_slot.append(slots[hit])
                jump[hit] = 1
            at = at + jump
            going = at < end
            at, end = at[going], end[going]
        if not found_at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, slots = np.concatenate(found_at), np.concatenate(found_slot)
        many = self.bucket[slots + 1] - self.bucket[slots]
        which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.bucket[slots], many)
        at, which = np.repeat(at, many), self.order[which]
        same = self.codes[self.at[which]] == ids[at]
        at, which = at[same], which[same]
        same = np.ones(len(at), bool)
        for lo in range(0, len(at), 100_000):
            piece = slice(lo, lo + 100_000)
            same[piece] = (ids[at[piece, None] + np.arange(self.length)] == self.codes[self.at[which[piece], None] + np.arange(self.length)]).all(axis=1)
        return at[same], which[same]


class Search:
    """Patterns of all lengths, and the items that each of them comes from."""

    def __init__(self, items: list[tuple[str | None, str]], window: int, block: int):
        items = [x for x in items if x[1]]
        words = Words(pa.array([text for _, text in items], pa.large_string()))
        coded = words.array.dictionary_encode()
        self.vocabulary = coded.dictionary
        codes = coded.indices.to_numpy().astype(np.int32)
        #: Item ids sorted as strings; windows of items without an id count as hits only.
        self.names = sorted({name for name, _ in items if name is not None})
        place = {name: k for k, name in enumerate(self.names)}
        owner = np.array([-1 if name is None else place[name] for name, _ in items], np.int64)
        sizes = np.diff(words.bounds)
        lengths = np.minimum(sizes, window)
        self.tables = []
        for length in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == length)
            many = sizes[own] - length + 1
            at = np.repeat(words.bounds[:-1][own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            which, first = distinct_windows(codes, at, length)
            pairs = np.unique(np.stack([which, np.repeat(owner[own], many)], axis=1), axis=0)
            pairs = pairs[pairs[:, 1] >= 0]
            starts = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
            self.tables.append((Patterns(codes[first[:, None] + np.arange(length)], block, codes=codes, at=first), starts, pairs[:, 1]))

    def rows(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start) pairs' starts and ends, and pairs of row and item."""
        if self.tables:
            ids = pc.index_in(words.array, value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        starts, ends, rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for table, begin, own in self.tables:
            at, which = table.find(ids, words.bounds)
            starts.append(at)
            ends.append(at + table.length)
            many = begin[which + 1] - begin[which]
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[which], many)
            rows.append(np.searchsorted(words.bounds, np.repeat(at, many), "right") - 1)
            items.append(own[nth])
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(rows), np.concatenate(items)


def distinct_windows(codes: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each window (from ``at``) among the different ones, and a place of each of those."""
    h = np.zeros(len(at), np.uint64)
    for k in range(length):
        h = (h ^ codes[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(at), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    # equal hashes are compared word by word; windows that only share a hash may be listed twice, which is harmless
    for k in range(length):
        letters = codes[at[order] + k]
        new[1:] |= letters[1:] != letters[:-1]
    which = np.empty(len(at), np.int64)
    which[order] = np.cumsum(new) - 1
    return which, at[order[new]]


def merged(mark: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of marked words, cut at row bounds: starts and ends."""
    padded = np.zeros(len(mark) + 1, bool)
    padded[: len(mark)] = mark
    first = padded[:-1].copy()
    inner = padded[:-1][:-1]
    first[1:] &= ~inner
    cut = bounds[:-1][bounds[:-1] < len(mark)]
    first[cut] |= padded[cut]
    last = padded[:-1] & ~padded[1:]
    cut = bounds[1:][bounds[1:] > 0] - 1
    last[cut] |= padded[cut]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block: int = 3, block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """``docs`` with what each text shares with the benchmark's items.

    Adds ``n_words`` (long), ``n_hit`` (words inside any occurrence of a window), ``hit_spans``
    (disjoint runs of such words, as ``start`` and ``end`` word numbers, end exclusive) and
    ``items`` (ids of the items with occurring windows, as sorted strings).  These replace input
    columns of the same names; all other columns and all rows stay (``keep_text=False`` leaves
    the text out, which saves its way back from Python).

    Null and empty texts have no words: zeros and empty lists.  An empty benchmark hits nothing.
    Items with null text are ignored; an item without an id hits but is not listed.  Repeated
    documents each get their row, repeated items count once; an empty table of documents gives an
    empty result.  Whole texts of any length are read.  There are no ties to break.
    """
    size = benchmark.agg(F.sum(F.octet_length(F.col(item_text)))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    out = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), ("items", T.ArrayType(T.StringType()))]
    kept = [c for c in without(docs, [n for n, _ in out]) if c != text]
    has_text = text in docs.columns and text not in [n for n, _ in out]
    body = "__text"
    schema = T.StructType([T.StructField(body, T.StringType()), *(docs.schema[c] for c in kept), *(T.StructField(n, t) for n, t in out)])
    df = docs.select(F.col(text).alias(body), *kept, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast(out[2][1]).alias("hit_spans"), F.array().cast("array<string>").alias("items"))
    for k in range(blocks):
        part = benchmark.select(F.col(item_id).cast("string"), F.col(item_text)).where(F.col(item_text).isNotNull())
        if blocks > 1:
            part = part.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) == k)
        search = docs.sparkSession.sparkContext.broadcast(Search([tuple(r) for r in part.toLocalIterator()], window, block))
        last = k == blocks - 1 and not (keep_text and has_text)
        df = df.mapInArrow(_pass(search, 1 if last else 0), T.StructType(schema[1:]) if last else schema)
    if not (keep_text and has_text):
        return df
    return df.withColumnRenamed(body, text).select(*[c for c in docs.columns if c in [*kept, text]], *[n for n, _ in out])


def _pass(search, skip: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = search.value
        for batch in batches:
            for lo, hi in chunks(batch.column(0)):
                yield _annotated(batch.slice(lo, hi - lo), found, skip)

    return run


def _annotated(batch: pa.RecordBatch, search: Search, skip: int) -> pa.RecordBatch:
    n = batch.num_rows
    words = Words(batch.column(0))
    starts, ends, rows, items = search.rows(words)
    bounds, total = words.bounds, len(words.array)
    spans = batch.column(batch.schema.get_field_index("hit_spans"))
    earlier = spans.flatten()
    if len(earlier):
        base = np.repeat(bounds[:-1], np.asarray(spans.value_lengths().fill_null(0)))
        starts = np.concatenate([starts, earlier.field(0).to_numpy() + base])
        ends = np.concatenate([ends, earlier.field(1).to_numpy() + base])
    depth = np.zeros(total + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    mark = np.cumsum(depth[:-1]) > 0
    first, last = merged(mark, bounds)
    hits = np.concatenate([[0], np.cumsum(mark)])
    row = np.searchsorted(bounds, first, "right") - 1
    span_counts = np.bincount(row, minlength=n)
    names = batch.column(batch.schema.get_field_index("items"))
    pairs = np.unique(rows * max(len(search.names), 1) + items)
    row_of, found = pairs // max(len(search.names), 1), pa.array(search.names, pa.string()).take(pa.array(pairs % max(len(search.names), 1)))
    if len(names.flatten()):
        table = pa.table({"row": np.concatenate([np.repeat(np.arange(n), np.asarray(names.value_lengths().fill_null(0))), row_of]), "name": pa.concat_arrays([names.flatten().cast(pa.string()), found])})
        # names of UTF-8 sort by bytes as they do by code point
        table = table.group_by(["row", "name"]).aggregate([]).sort_by([("row", "ascending"), ("name", "ascending")])
        row_of, found = table.column("row").to_numpy(), table.column("name").combine_chunks()
    item_column = lists(np.bincount(row_of, minlength=n), found)
    new = {
        "n_words": pa.array(np.diff(bounds)),
        "n_hit": pa.array(hits[bounds[1:]] - hits[bounds[:-1]]),
        "hit_spans": lists(span_counts, pa.StructArray.from_arrays([pa.array(first - bounds[row]), pa.array(last - bounds[row])], ["start", "end"])),
        "items": item_column,
    }
    names = batch.schema.names[skip:]
    return pa.RecordBatch.from_arrays([new.get(name, column) for name, column in zip(names, batch.columns[skip:])], names=names)


def contaminated() -> Column:
    """The contract's rule over the added columns: at least 5% of the words are hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
