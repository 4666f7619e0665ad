"""Substring deduplication by repeated-phrase automata.

1. Candidates.  In every window of ``window`` words the phrase of ``window // 2`` words with the
   smallest hash is marked.  Equal windows mark equal phrases, so a window that recurs contains a
   mark that recurs; a few marks per hundred words are shuffled, and those of one document only
   are dropped.
2. Confirmed passages.  Windows around recurring marks are hashed to 128 bits; for those in two
   documents or more the smallest document is their home.  Runs of windows with one home are a
   passage, so each recurring window lies in one passage exactly.
3. Automata.  A passage is cut into phrases of ``window // 2`` words; every window of it contains
   one of them whole.  The phrases, as numbers of exact words, are compiled into Aho-Corasick
   automata, in shards of about ``SHARD_WORDS`` words by home.
4. Every document streams through the automata of the homes that it shares windows with.  From
   each phrase found, text and passages of these homes are compared word by word along the whole
   overlap; what agrees for at least a window is removed if the home is a smaller document.  So a
   phrase that very many passages begin with costs no more than the homes that a document has.

Hashes only say where to look: nothing is removed that was not compared.  Exact copies of whole
texts are settled beforehand, since all their windows start in the first of them, so a group of
copies counts as one text.  Shards that many documents need are dealt out over as many tasks, and
a task holds one automaton and one document at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterlake.llm.common import chunks, lists, materialise, small, spread_join, utf8, without
from letterlake.llm.jaccard import mixed

WINDOW = 50
#: Words of the passages of an automaton, about, and bytes of text that a task streams through one.
SHARD_WORDS = 200_000
STREAMED = 4_000_000
_BASE = 0x9E3779B97F4A7C15
_OTHER = 0xC2B2AE3D27D4EB4F
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of some texts, unchanged: ``array``, and ``bounds`` of each row."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8(column)
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        places = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=places[1:])
        self.bounds = np.searchsorted(self.starts, offsets).astype(np.int64)
        self.places, self.letters = places, data[inside]
        self.array = pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(places), pa.py_buffer(self.letters))

    def hashes(self, base: int) -> np.ndarray:
        return runs(self.letters, self.places[:-1], self.places[1:], base)


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of each run of ``values``."""
    n = len(values) + 1
    power, back = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 2**64), np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    prefix = np.zeros(n, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:-1], out=prefix[1:])
    return mixed((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(base))


def phrase_hashes(words: np.ndarray, bounds: np.ndarray, length: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all phrases of ``length`` words within a row, and their hashes."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(row[: max(len(row) - length + 1, 0)] == row[length - 1 :])
    return at, runs(words, at, at + length, base)


def marks(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the marked phrases: in each window the smallest, of equal ones the last."""
    size = window // 2
    at, h = phrase_hashes(words.hashes(_BASE), words.bounds, size, _BASE)
    if not len(at):
        return at, h
    # smallest of each stretch of window - size + 1 phrases, by doubling; rows are kept apart below
    reach = window - size + 1
    place = np.arange(len(at))

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(h[b] <= h[a], b, a)

    span, best = 1, place
    while span * 2 <= reach:
        best = lower(best[: len(best) - span], best[span:]) if len(best) > span else best[:0]
        span *= 2
    if reach > span:
        more = reach - span
        best = lower(best[: len(best) - more], best[more:]) if len(best) > more else best[:0]
    # a stretch is a window only if its phrases follow each other in one row
    whole = at[: len(best)] + reach - 1 == at[reach - 1 : reach - 1 + len(best)]
    same = np.searchsorted(words.bounds, at[: len(best)], "right") == np.searchsorted(words.bounds, at[reach - 1 : reach - 1 + len(best)], "right")
    chosen = np.unique(best[whole & same])
    return at[chosen], h[chosen]


def _marked(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(id, digest, text) -> key, id, digest, at."""
    for batch in batches:
        for lo, hi in chunks(batch.column(2)):
            words = Words(batch.column(2).slice(lo, hi - lo))
            at, h = marks(words, window)
            row = np.searchsorted(words.bounds, at, "right") - 1
            rows = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at - words.bounds[row]).astype(np.int32))], names=["key", "id", "digest", "at"])


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(id, digest, text, ats) -> a, b, id, digest, at of the windows that contain a phrase at one of ``ats``."""
    size = window // 2
    for batch in batches:
        for lo, hi in chunks(batch.column(2)):
            words = Words(batch.column(2).slice(lo, hi - lo))
            ats = batch.column(3).slice(lo, hi - lo)
            n = len(words.array)
            spots = ats.flatten().to_numpy() + np.repeat(words.bounds[:-1], np.asarray(ats.value_lengths()))
            near = np.zeros(n + 1, np.int64)
            np.add.at(near, np.maximum(spots - (window - size), 0), 1)
            np.add.at(near, spots + 1, -1)
            near = np.cumsum(near[:-1]) > 0
            at, a = phrase_hashes(words.hashes(_BASE), words.bounds, window, _BASE)
            own = near[at]
            at, a = at[own], a[own]
            b = runs(words.hashes(_OTHER), at, at + window, _OTHER)
            row = np.searchsorted(words.bounds, at, "right") - 1
            for k in range(0, len(at), 100_000):
                piece = slice(k, k + 100_000)
                rows = pa.array(row[piece] + lo)
                yield pa.RecordBatch.from_arrays([pa.array(a[piece].view(np.int64)), pa.array(b[piece].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at - words.bounds[row])[piece].astype(np.int32))], names=["a", "b", "id", "digest", "at"])


def _passages(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(shard, home, id, text, ats) -> shard, home, id, and the words of each run of windows at ``ats``, joined by blanks."""
    for batch in batches:
        words = Words(batch.column("text"))
        rows, out = [], []
        for row, ats in enumerate(batch.column("ats").to_pylist()):
            at = np.unique(np.array(ats, np.int64)) + words.bounds[row]
            cuts = np.flatnonzero(np.diff(at) > 1) + 1
            for run in np.split(at, cuts):
                rows.append(row)
                out.append(words.array.slice(int(run[0]), int(run[-1] - run[0]) + window))
        joined = pc.binary_join(pa.array([x.to_pylist() for x in out], pa.list_(pa.string())), " ")
        rows = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("shard", "home", "id")), joined], names=["shard", "home", "id", "text"])


class Shard:
    """The automaton of some passages (home, document and words joined by blanks): each phrase leads to its places by home."""

    def __init__(self, passages: list[tuple[int, object, str]], window: int):
        self.window, self.size = window, window // 2
        self.owners = [ident for _, ident, _ in passages]
        words = Words(pa.array([text for *_, text in passages], pa.large_string()))
        coded = words.array.dictionary_encode()
        self.vocabulary, self.codes, self.bounds = coded.dictionary, coded.indices.to_numpy().astype(np.int64), words.bounds
        found: dict[tuple[int, ...], dict[int, list[tuple[int, int]]]] = {}
        for k, (home, *_) in enumerate(passages):
            for at in range(self.bounds[k], self.bounds[k + 1] - self.size + 1, self.size):
                found.setdefault(tuple(self.codes[at : at + self.size].tolist()), {}).setdefault(home, []).append((k, int(at - self.bounds[k])))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase, places in found.items():
            self.automaton.add_word(phrase, places)
        self.automaton.make_automaton()

    def spans(self, ident: object, homes: list[int], text: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of ``text`` (word numbers; -1 for words that no passage has) that passages of smaller documents among ``homes`` cover."""
        out, seen, own_homes = [], set(), set(homes)
        unknown = len(self.vocabulary)
        for end, places in self.automaton.iter(tuple(np.where(text < 0, unknown, text).tolist())):
            near = homes if len(homes) < len(places) else places
            for k, at in (x for home in near for x in places.get(home, ()) if home in own_homes):
                # text word t stands against passage word t - shift
                shift = end - self.size + 1 - at
                if (k, shift) in seen or not self.owners[k] < ident:
                    continue
                seen.add((k, shift))
                own = self.codes[self.bounds[k] : self.bounds[k + 1]]
                lo, hi = max(shift, 0), min(shift + len(own), len(text))
                same = np.zeros(hi - lo + 2, bool)
                same[1:-1] = text[lo:hi] == own[lo - shift : hi - shift]
                edges = np.flatnonzero(same[1:] != same[:-1])
                out += [(lo + a, lo + b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= self.window]
        return out


def _streamed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(shard, part, kind, id, digest, homes, text), sorted by the first three: passages (kind 0), then documents (kind 1) -> id, digest, starts, ends."""
    own, passages, shard = None, [], None
    for batch in batches:
        names = list(zip(batch.column("shard").to_pylist(), batch.column("part").to_pylist(), batch.column("kind").to_pylist()))
        begins = [k for k, name in enumerate(names) if not k or name != names[k - 1]]
        for lo, hi in zip(begins, [*begins[1:], len(names)]):
            ids, texts, homes = (batch.column(c).slice(lo, hi - lo) for c in ("id", "text", "homes"))
            if names[lo][:2] != own:
                own, passages, shard = names[lo][:2], [], None
            if names[lo][2] == 0:
                passages += zip((x[0] for x in homes.to_pylist()), ids.to_pylist(), texts.to_pylist())
                continue
            if shard is None:
                shard, passages = Shard(passages, window), []
            # many texts at once, because the vocabulary is hashed for each call
            for at, end in chunks(texts, STREAMED):
                words = Words(texts.slice(at, end - at))
                numbers = pc.index_in(words.array, value_set=shard.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
                each = enumerate(zip(ids.slice(at, end - at).to_pylist(), homes.slice(at, end - at).to_pylist()))
                spans = [sorted(set(shard.spans(ident, near, numbers[words.bounds[k] : words.bounds[k + 1]]))) for k, (ident, near) in each]
                rows = pa.array([k for k, x in enumerate(spans) if x], pa.int64())
                starts, ends = (pa.array([[x[side] for x in spans[k]] for k in rows.to_pylist()], pa.list_(pa.int32())) for side in (0, 1))
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at).take(rows), batch.column("digest").slice(lo + at, end - at).take(rows), starts, ends], names=["id", "digest", "starts", "ends"])


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(copied, starts, ends, text, ...) -> the other columns, then n_words, n_removed, kept, removed."""
    for batch in batches:
        for lo, hi in chunks(batch.column(3)):
            piece = batch.slice(lo, hi - lo)
            words = Words(piece.column(3))
            n, bounds = len(words.array), words.bounds
            depth = np.zeros(n + 1, np.int64)
            for name, sign in ((1, 1), (2, -1)):
                column = piece.column(name)
                base = np.repeat(bounds[:-1], np.asarray(column.value_lengths().fill_null(0)))
                np.add.at(depth, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + base, sign)
            gone = np.cumsum(depth[:-1]) > 0
            sizes = np.diff(bounds)
            whole = piece.column(0).fill_null(False).to_numpy(zero_copy_only=False) & (sizes >= window)
            gone |= np.repeat(whole, sizes)
            upto = np.concatenate([[0], np.cumsum(gone)])
            removed = upto[bounds[1:]] - upto[bounds[:-1]]
            kept = pc.binary_join(lists(sizes - removed, words.array.filter(pa.array(~gone)).cast(pa.string())), " ")
            # disjoint runs of removed words
            row = np.repeat(np.arange(len(sizes)), sizes)
            first, last = gone.copy(), gone.copy()
            first[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
            last[:-1] &= ~gone[1:] | (row[1:] != row[:-1])
            first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
            runs_ = pa.StructArray.from_arrays([pa.array(first - bounds[row[first]]), pa.array(last - bounds[row[first]])], ["start", "end"])
            spans = lists(np.bincount(row[first], minlength=len(sizes)), runs_)
            columns = [*piece.columns[4:], pa.array(sizes), pa.array(removed), kept, spans]
            yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names[4:], "n_words", "n_removed", "kept", "removed"])


def first_texts(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) with ``digest`` and ``copied``: whether a smaller document has the same text."""
    df = docs.withColumn("digest", F.xxhash64("text")).withColumn("other", F.xxhash64(F.lit("passages"), "text"))
    keys = df.where("text IS NOT NULL AND id IS NOT NULL").groupBy("digest", "other").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").drop("last")
    keys = materialise(keys, "passages-copies")
    total = keys.agg(F.sum("n")).first()[0] or 0
    met = spread_join(df, keys, ["digest", "other"], "n", total, "left")
    return met.withColumn("copied", F.coalesce(F.col("id") > F.col("first"), F.lit(False))).drop("other", "first")


def repeated_spans(texts: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """id, digest, ``starts`` and ``ends`` (word numbers, in lists that may overlap) of what smaller documents have, of different ``texts`` (id, digest, text)."""
    kind = texts.schema["id"]
    texts = texts.where(F.octet_length("text") >= 2 * window - 1)
    found = texts.mapInArrow(lambda batches: _marked(batches, window), T.StructType([T.StructField("key", T.LongType()), kind, T.StructField("digest", T.LongType()), T.StructField("at", T.IntegerType())]))
    found = materialise(found, "passages-marks")
    keys = found.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("key", "n")
    keys = materialise(keys, "passages-keys")
    near = spread_join(found, keys, ["key"], "n", keys.agg(F.sum("n")).first()[0] or 0)
    near = materialise(near.groupBy("id", "digest").agg(F.collect_set("at").alias("ats")), "passages-near")
    met = texts.join(small(near), ["id", "digest"]).select("id", "digest", "text", "ats")
    place = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), kind, T.StructField("digest", T.LongType()), T.StructField("at", T.IntegerType())])
    windows = materialise(met.mapInArrow(lambda batches: _windows(batches, window), place), "passages-windows")
    homes = windows.groupBy("a", "b").agg(F.min(F.struct("id", "digest", "at")).alias("home"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("home.id < high")
    homes = materialise(homes.select("a", "b", "home", "n"), "passages-homes")
    # windows of a home, and the words that their passages have at most
    own = homes.groupBy(F.col("home.id").alias("id"), F.col("home.digest").alias("digest")).agg(F.collect_set("home.at").alias("ats"), F.count(F.lit(1)).alias("many"))
    total, size = homes.agg(F.sum("n"), F.count(F.lit(1))).first()
    shards = max(1, -(-size // shard_words))
    shard = F.pmod(F.xxhash64("id", "digest"), F.lit(shards)).cast("int")
    own = materialise(own.withColumn("shard", shard).withColumn("home", F.xxhash64("id", "digest")), "passages-own")
    passages = texts.join(small(own.drop("many")), ["id", "digest"]).select("shard", "home", "id", "text", "ats")
    passages = materialise(passages.mapInArrow(lambda batches: _passages(batches, window), T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("home", T.LongType()), kind, T.StructField("text", T.StringType())])), "passages-texts")
    # which documents share windows with which homes of which shard
    needs = spread_join(windows, homes, ["a", "b"], "n", total or 0, wide=True).where(F.col("id") > F.col("home.id"))
    needs = needs.select("id", "digest", F.xxhash64(F.col("home.id"), F.col("home.digest")).alias("home")).distinct()
    needs = needs.groupBy("id", "digest", F.pmod(F.col("home"), F.lit(shards)).cast("int").alias("shard")).agg(F.collect_list("home").alias("homes"))
    needs = materialise(needs, "passages-needs")
    routed = texts.join(small(needs), ["id", "digest"]).select("shard", "id", "digest", "homes", "text")
    # as many parts of a shard as its documents need tasks
    per = small(needs.groupBy("shard").agg(F.count(F.lit(1)).alias("docs")))
    average = texts.agg(F.avg(F.octet_length("text"))).first()[0] or 1
    parts = F.ceil(F.col("docs") / max(1, int(STREAMED // average))).cast("int")
    per = materialise(per.select("shard", parts.alias("parts")), "passages-parts")
    routed = routed.join(F.broadcast(per) if shards <= 100_000 else per, "shard").withColumn("part", F.pmod(F.xxhash64("id", "digest"), F.col("parts")).cast("int"))
    patterns = passages.join(F.broadcast(per) if shards <= 100_000 else per, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = patterns.select("shard", "part", F.lit(0).alias("kind"), "id", F.lit(None).cast("long").alias("digest"), F.array("home").alias("homes"), "text").unionByName(routed.select("shard", "part", F.lit(1).alias("kind"), "id", "digest", "homes", "text"))
    both = both.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    ints = T.ArrayType(T.IntegerType())
    return both.mapInArrow(lambda batches: _streamed(batches, window), T.StructType([kind, T.StructField("digest", T.LongType()), T.StructField("starts", ints), T.StructField("ends", ints)]))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined by one blank) and ``removed`` (runs of word numbers, end exclusive).

    A word goes if a window of ``window`` words that covers it also starts in a document with a
    smaller id; windows are judged on the texts as given.  Null and empty texts have no words, and
    texts shorter than a window lose none.  Rows with a null id neither lose words nor take any
    from others; rows with the same id do not take from each other, whether their texts are equal
    (repeated rows) or not.  Within a document nothing is compared.  Texts of any length are read
    whole.  Input columns named like results are replaced, all others stay; ``keep_text=False``
    leaves the text out.  An empty table gives an empty result.
    """
    # under names of its own, whatever the columns of docs are called
    named = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *(F.col(f"`{c}`").alias(f"__own_{k}") for k, c in enumerate(docs.columns)))
    marked = first_texts(named)
    texts = marked.where("NOT copied AND id IS NOT NULL AND text IS NOT NULL").select("id", "digest", "text")
    spans = repeated_spans(texts, window).groupBy("id", "digest").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    spans = small(materialise(spans, "passages-spans"))
    out = ["n_words", "n_removed", "kept", "removed"]
    kept = [c for c in without(docs, out) if keep_text or c != text]
    numbers = {c: f"__own_{k}" for k, c in enumerate(docs.columns)}
    df = marked.join(spans, ["id", "digest"], "left").select("copied", "starts", "ends", "text", *(numbers[c] for c in kept))
    schema = T.StructType([*(df.schema[numbers[c]] for c in kept), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    df = df.mapInArrow(lambda batches: _cut(batches, window), schema)
    return df.select(*(F.col(numbers[c]).alias(c) for c in kept), *out)
