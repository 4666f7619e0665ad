"""N-gram Jaccard join by MinHash banding.

Documents with the same set of n-grams are one class from the start.  Each class has a MinHash
signature; bands of rows are chosen so that a pair at the threshold shares a band with the target
recall.  Classes that share a band are candidates; candidates are gathered by connected components
of the bands, cut into blocks, and all pairs of a block pair are compared on their full n-gram
sets.  A set travels to its blocks as its difference from the set of the component's smallest
member, which for near copies is a few n-grams.  Only counts and a spanning set of links leave a
task, never all pairs of a group.

Copies are counted, not expanded: a document's links are its copies and the members of all linked
classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterlake.llm.common import HEAVY_ROWS, Words, chunks, is_small, materialise, small, spread_join, without
from letterlake.llm.components import components, in_blocks, stars, with_group

#: Words of an n-gram; a shorter text with words is one n-gram.
NGRAM = 5
THRESHOLD = 0.8
#: Share of pairs at the threshold that must share a band, and hash functions to spend on it.
RECALL = 0.9999
MOST_HASHES = 128
#: Classes and text bytes of a block.
BLOCK_ROWS = 256
BLOCK_BYTES = 16_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


def bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most selective rows per band for which the recall needs at most ``most`` hashes."""
    for rows in range(most, 0, -1):
        share = threshold**rows
        number = math.ceil(math.log(1 - recall) / math.log(1 - share)) if share < 1 else 1
        if number * rows <= most:
            return number, rows
    return most, 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def ngrams(words: Words, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of each row, and the row bounds among them."""
    coded = words.array.dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = each[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    sizes = np.diff(words.bounds)
    out = np.zeros(len(h), np.uint64)
    for k in range(n):
        part = np.zeros(len(h), np.uint64)
        part[: len(h) - k] = h[k:]
        out = mixed(out * _P + part) if k else mixed(part)
    keep = np.ones(len(h), bool)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    drop = sizes - counts
    at = np.repeat(words.bounds[1:] - drop, drop) + (np.arange(drop.sum()) - np.repeat(np.cumsum(drop) - drop, drop))
    keep[at] = False
    for row in np.flatnonzero((sizes > 0) & (sizes < n)):
        lo, hi = words.bounds[row], words.bounds[row + 1]
        value = np.array([hi - lo], np.uint64)
        for k in range(lo, hi):
            value = mixed(value * _P + h[k : k + 1])
        out[lo] = value[0]
    return out[keep], np.concatenate([[0], np.cumsum(counts)])


def _signed(batches: Iterator[pa.RecordBatch], n: int, number: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Without the text (column 0): key of the n-gram set, and one bucket per band."""
    rng = np.random.default_rng(20240229)
    factors = rng.integers(0, 2**63, number * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 2**63, number * rows, dtype=np.uint64)
    for batch in batches:
        for lo, hi in chunks(batch.column(0)):
            piece = batch.slice(lo, hi - lo)
            h, bounds = ngrams(Words(piece.column(0)), n)
            full = np.flatnonzero(np.diff(bounds))
            begin = bounds[:-1][full]
            bucket = np.zeros((len(full), number), np.uint64)
            for b in range(number if len(full) else 0):
                value = np.full(len(full), b, np.uint64)
                for k in range(b * rows, (b + 1) * rows):
                    value = mixed(value * _P + np.minimum.reduceat(h * factors[k] + offsets[k], begin))
                bucket[:, b] = value
            keys: list[str | None] = [None] * piece.num_rows
            for r in full.tolist():
                keys[r] = xxhash.xxh3_128_hexdigest(np.unique(h[bounds[r] : bounds[r + 1]]).tobytes())
            sizes = np.zeros(piece.num_rows, np.int64)
            sizes[full] = number
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(bucket.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*piece.columns[1:], pa.array(keys, pa.string()), lists], names=[*piece.schema.names[1:], "key", "buckets"])


def _grams(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Instead of the text (column 0), last: the sorted n-gram set, as bytes."""
    for batch in batches:
        for lo, hi in chunks(batch.column(0)):
            piece = batch.slice(lo, hi - lo)
            h, bounds = ngrams(Words(piece.column(0)), n)
            sets = [np.unique(h[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([*piece.columns[1:], pa.array(sets, pa.binary())], names=[*piece.schema.names[1:], "grams"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """root, item, copies, grams, lead, own, where a base (``lead``) stands before the rows that it is for: for those with ``own``,
    root, item, copies, the sizes of the item's set, of what it shares with the base and of the base, and the n-grams that only one of the two has."""
    names = ["root", "item", "copies", "size", "common", "whole", "rest", "bytes"]
    base = np.zeros(0, np.uint64)
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for grams, lead, own in zip(batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist()):
            grams = np.frombuffer(grams.as_buffer(), np.uint64)
            if lead:
                base = grams.copy()
            if own:
                rest = np.setxor1d(grams, base, assume_unique=True)
                out[0].append(len(grams))
                out[1].append((len(grams) + len(base) - len(rest)) // 2)
                out[2].append(len(base))
                out[3].append(rest.tobytes())
        kept = batch.filter(batch.column(5))
        yield pa.RecordBatch.from_arrays([*kept.columns[:3], *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary()), pa.array([len(x) for x in out[3]], pa.int64())], names=names)


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over n-grams that several have."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    rows, column = rows[keep], np.cumsum(count > 1)[column[keep]] - 1
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    both = np.zeros((n, n), np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        x = np.zeros((n, 4096), np.float32)
        x[rows[a:b], column[a:b] - lo] = 1
        both += x @ x.T
    return both


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component, for pairs of 0..n-1."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal ``keys`` in sorted batches, one table each."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(batch.schema.get_field_index(k))[row].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = batch.column(batch.schema.get_field_index(k))
            values = column.dictionary_encode().indices.to_numpy() if pa.types.is_string(column.type) else column.to_numpy()
            change[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and key(held[0], 0) != key(batch, lo):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _linked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Per group: each item's links (with copies) and the smallest item that links join it with."""
    for group in grouped(batches, ["root", "i", "j"]):
        if len(group) < 2:
            continue
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("rest")]
        copies, block = group.column("copies").to_numpy(), group.column("block").to_numpy()
        sizes, common, whole = (group.column(c).to_numpy() for c in ("size", "common", "whole"))
        # what both lack of the base, and what both have beyond it, are the common parts of their differences
        both = shared(sets) + common[:, None] + common[None, :] - whole[:, None]
        near = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
        near &= (block[:, None] != block[None, :]) if group.column("i")[0] != group.column("j")[0] else ~np.eye(len(sets), dtype=bool)
        some = np.flatnonzero(near.any(axis=1))
        if len(some):
            items = group.column("item").combine_chunks()
            order = np.argsort(np.array(items.to_pylist()), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            a, b = np.nonzero(near)
            root = order[roots(len(sets), place[a], place[b])[place]]
            yield pa.RecordBatch.from_arrays([items.take(pa.array(some)), pa.array((near[some] @ copies).astype(np.int64)), items.take(pa.array(root[some]))], names=["item", "links", "to"])


def _classes(docs: DataFrame, text: str, doc_id: str, n: int, threshold: float, recall: float) -> DataFrame:
    """id, digest (of the text), class_id, class_key, n_links and n_copies of every row."""
    number, rows = bands(threshold, recall)
    digest = F.xxhash64(F.col(text))
    base = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("id"), digest.alias("digest"), F.octet_length(F.col(text)).cast("long").alias("bytes"))
    schema = f"id {dict(docs.dtypes)[doc_id]}, digest long, bytes long, key string, buckets array<long>"
    signed = materialise(base.mapInArrow(lambda batches: _signed(batches, n, number, rows), schema), "jaccard-signed")
    with_key = signed.where("key IS NOT NULL")
    # one row per n-gram set: the text with the smallest digest (of the document with its smallest id) stands for it
    sets = with_key.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("digest", "id")).alias("first"))
    sets = materialise(sets.select("key", "rep", "copies", F.col("first.digest").alias("digest"), F.col("first.id").alias("own")), "jaccard-sets")
    # candidates by a short hash of the key: two keys that share one are candidates too, and are compared
    members = with_key.select(F.xxhash64("key").alias("item"), F.explode("buckets").alias("bucket"))
    near = small(materialise(components(stars(members)), "jaccard-near"))
    near = sets.join(near, F.xxhash64("key") == F.col("node")).withColumnRenamed("key", "item")
    near = materialise(near, "jaccard-candidates")
    # each set is computed where its text lies and is shuffled once: to meet the set of its component's smallest member
    lead = near.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("node") == F.col("root"), F.col("item"))).alias("base"))
    led = materialise(with_group(near, "root", lead).select("digest", "own", "root", "item", "copies", (F.col("item") == F.col("base")).alias("lead"), F.ceil(F.col("n") / HEAVY_ROWS).cast("int").alias("parts")), "jaccard-led")
    texts = docs.select(F.col(text).alias("text"), digest.alias("__digest"), F.col(doc_id).alias("__id"))
    texts = texts.join(small(led), (F.col("__digest") == F.col("digest")) & F.col("__id").eqNullSafe(F.col("own")))
    grams = texts.select("text", "root", "item", "copies", "lead", "parts").mapInArrow(lambda batches: _grams(batches, n), "root long, item string, copies long, lead boolean, parts int, grams binary")
    grams, total = materialise(grams, "jaccard-grams"), near.count()
    if grams.count() > total:
        # rows with the same id and text
        grams = materialise(grams.dropDuplicates(["item"]), "jaccard-grams")
    # a large component is dealt out in parts, and its smallest member's set goes to all of them; the other sets become their differences from it
    part = F.pmod(F.xxhash64("item"), F.col("parts")).cast("int")
    dealt = grams.withColumn("part", F.explode(F.when(F.col("lead"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))))
    dealt = dealt.select("root", "item", "copies", "grams", "lead", (F.col("part") == part).alias("own"), "part").repartition("root", "part").sortWithinPartitions("root", "part", F.desc("lead"))
    coded = dealt.drop("part").mapInArrow(_differences, "root long, item string, copies long, size long, common long, whole long, rest binary, bytes long")
    coded = materialise(coded, "jaccard-coded")
    groups = in_blocks(coded, BLOCK_ROWS, BLOCK_BYTES)
    groups = groups.select("root", "i", "j", "item", "block", "copies", "size", "common", "whole", "rest").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    linked = materialise(groups.mapInArrow(lambda batches: _linked(batches, threshold), "item string, links long, to string"), "jaccard-links")
    found = materialise(components(linked.select(F.col("item").alias("u"), F.col("to").alias("v"))).withColumnRenamed("node", "key"), "jaccard-found")
    reps = small(found).join(sets.select("key", "rep"), "key").groupBy("root").agg(F.min("rep").alias("class"))
    links = linked.groupBy(F.col("item").alias("key")).agg(F.sum("links").alias("links"))
    # most sets have one document and no links: their documents need not meet them
    classes = sets.join(small(with_group(found, "root", reps)), "key", "left").join(small(links), "key", "left").where("copies > 1 OR root IS NOT NULL OR links IS NOT NULL")
    classes = classes.select("key", F.coalesce("root", "key").alias("class_key"), F.coalesce("class", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("copies").alias("n_copies"), "copies")
    classes, by_row = materialise(classes, "jaccard-classes"), with_key.select("id", "digest", "key")
    by_row = by_row.join(F.broadcast(classes.drop("copies")), "key", "left") if is_small(classes) else spread_join(by_row, classes, ["key"], "copies", signed.count(), "left")
    count = lambda c, alone: F.coalesce(c, F.lit(alone)).cast("long").alias(c)
    found = by_row.select("id", "digest", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_key", "key").alias("class_key"), count("n_links", 0), count("n_copies", 1))
    bare = signed.where("key IS NULL").select("id", "digest", F.col("id").alias("class_id"), F.lit(None).cast("string").alias("class_key"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return found.unionByName(bare)


def near_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``class_id``, ``n_links`` and ``n_copies``.

    Two documents are linked if the Jaccard similarity of their n-gram sets is at least
    ``threshold`` (documents with equal sets always are).  ``class_id`` is the smallest id in the
    document's connected component, ``n_links`` the number of other documents linked to it, and
    ``n_copies`` that of documents with its n-gram set (itself included).

    Null and empty texts, and those without words, have no n-grams: each is its own class with no
    links.  Repeated rows count as documents with the same id.  Null ids are ignored as class ids
    where another id is there.  Input columns named like results are replaced; an empty table
    gives an empty result.  ``keep_text=False`` leaves the text out.
    """
    names = ["class_id", "n_links", "n_copies"]
    kept = [c for c in without(docs, names) if keep_text or c != text]
    found = _classes(docs, text, doc_id, n, threshold, recall)
    if set(kept) <= {doc_id}:
        return found.select(F.col("id").alias(doc_id), *names)
    found = small(materialise(found.distinct(), "jaccard-rows")).alias("r")
    rest = docs.select(*kept, F.col(doc_id).alias("__id"), F.xxhash64(F.col(text)).alias("__digest")).alias("d")
    return rest.join(found, (F.col("__digest") == F.col("digest")) & F.col("__id").eqNullSafe(F.col("id")), "left").select(*(F.col(f"d.{c}") for c in kept), *names)


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id (then text digest).

    Documents without n-grams are classes of their own and all stay; of repeated rows with the
    same id and text one stays.  Only documents of classes with links are looked up; the others
    pass without a shuffle of their texts.
    """
    found = materialise(_classes(docs, text, doc_id, n, threshold, recall).where("class_key IS NOT NULL AND n_links > 0"), "jaccard-linked")
    place = F.struct(F.col("id").isNull(), "id", "digest")
    first = found.groupBy("class_key").agg(F.min(place).alias("first"))
    rows = with_group(found.groupBy("class_key", "id", "digest").agg(F.count(F.lit(1)).alias("n")), "class_key", first)
    rows = rows.select("id", "digest", (place == F.col("first")).alias("stays"), "n")
    marked = materialise(rows.where("NOT stays OR n > 1").groupBy("id", "digest").agg(F.max("stays").alias("__stays")).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "__stays"), "jaccard-marked")
    own = docs.withColumn("__own", F.xxhash64(F.col(text)))
    same = (F.col("__own") == F.col("__digest")) & F.col(doc_id).eqNullSafe(F.col("__id"))
    out = own.join(small(marked), same, "left_anti").drop("__own")
    again = marked.where("__stays")
    if again.isEmpty():
        return out
    repeated = own.join(small(again), same, "left_semi")
    return out.unionByName(repeated.dropDuplicates([doc_id, "__own"]).drop("__own"))
