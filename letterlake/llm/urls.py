"""URL filters by a Bloom filter cascade.

A cascade answers membership exactly for every key of a known universe, without a join: level 0
is a Bloom filter of the listed keys; level 1 one of the universe's keys that level 0 wrongly
lets pass; level 2 one of the listed keys that level 1 lets pass; and so on until no key is
wrong.  The universe is every key that the corpus itself asks about, so the answers are exact for
the corpus.  The levels hold some bits per listed key, whatever the size of the corpus.

Keys are host suffixes with path prefixes, of as many labels as some rule or listed host has.  The
distinct keys of the corpus are gathered with Spark (a hot host is one key after map-side
aggregation), written once, and each level is built from the keys that are still wrong.

Keys travel as 64-bit hashes.  A second hash shows whether a listed key shares its first one with
another key of the universe; if so, all are hashed again with another seed, so no answer rests on a
collision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterlake.llm.common import materialise, without

#: Bytes that all levels of one cascade may have on the driver and each executor; a longer list is cut into parts by key hash.
MOST_BYTES = 64_000_000
#: Share of foreign keys that a level lets pass.
RATE = 0.05
#: Words of a filter that come to the driver in one row.
PAGE = 4096
#: The rules of the registered query: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words in a host's label that put it on the query's list, which is a stand-in: no public domain list is at hand
#: here, and a production run passes its own (``listed``).
LISTED_WORDS = ("casino", "pills", "porn", "viagra", "xxx")


@dataclass
class Level:
    """A Bloom filter of 64-bit key hashes."""

    bits: int
    probes: int
    words: np.ndarray = field(repr=False)

    @staticmethod
    def places(hashes: np.ndarray, bits: int, probes: int, salt: int) -> np.ndarray:
        h = hashes.astype(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
        mixed = []
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
            mixed.append(h ^ (h >> np.uint64(31)))
        step = mixed[1] | np.uint64(1)
        return (mixed[0][:, None] + np.arange(probes, dtype=np.uint64) * step[:, None]) % np.uint64(bits)

    def has(self, hashes: np.ndarray, salt: int) -> np.ndarray:
        at = self.places(hashes, self.bits, self.probes, salt)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def shape(keys: int, rate: float) -> tuple[int, int]:
    """Bits (a multiple of 64) and probes for that many keys."""
    bits = -(-max(64, int(np.ceil(-keys * np.log(rate) / np.log(2) ** 2))) // 64) * 64
    return bits, max(1, round(bits / max(keys, 1) * np.log(2))) if keys else 1


class Cascade:
    """Levels for alternately listed keys and keys that the level before lets pass wrongly."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each key (of the universe) is listed."""
        n = len(hashes)
        out, rest = np.zeros(n, bool), np.arange(n)
        for k, level in enumerate(self.levels):
            if not len(rest):
                break
            passed = level.has(hashes[rest], k)
            # a key that level k lacks belongs to the other kind than level k encodes
            out[rest[~passed]] = k % 2 == 1
            rest = rest[passed]
        out[rest] = len(self.levels) % 2 == 1
        return out


def build(labelled: DataFrame, rate: float = RATE) -> Cascade:
    """The cascade for ``labelled``: ``key`` hashes (long, distinct) and ``listed`` (boolean)."""
    levels: list[Level] = []
    wrong = labelled
    while True:
        k = len(levels)
        own = wrong.where(F.col("listed") == (k % 2 == 0))
        count = own.count()
        if not count:
            return Cascade(levels)
        bits, probes = shape(count, rate if k else rate / 2)

        def places(batches: Iterator[pa.RecordBatch], bits=bits, probes=probes, k=k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(Level.places(batch.column(0).to_numpy(), bits, probes, k))
                word = (at >> np.uint64(6)).astype(np.int64)
                first = np.flatnonzero(np.diff(word, prepend=-1))
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(first) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(value.view(np.int64))], ["word", "value"])

        def page(key: tuple, table: pa.Table) -> pa.Table:
            out = np.zeros(PAGE, np.int64)
            out[table.column("word").to_numpy() % PAGE] = table.column("value").to_numpy()
            return pa.table({"page": pa.array([key[0].as_py()], pa.int64()), "words": pa.array([out.tobytes()], pa.binary())})

        # at most bits / 64 words: a filter's size, not a document's or key's
        words = np.zeros(-(-bits // 64 // PAGE) * PAGE, np.int64)
        merged = own.select("key").mapInArrow(places, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
        for row in merged.groupBy(F.expr(f"word div {PAGE}").alias("page")).applyInArrow(page, "page long, words binary").toLocalIterator():
            words[row[0] * PAGE : (row[0] + 1) * PAGE] = np.frombuffer(row[1], np.int64)
        words = words.view(np.uint64)
        levels.append(Level(bits, probes, words))
        level = labelled.sparkSession.sparkContext.broadcast(levels[-1])

        def passing(batches: Iterator[pa.RecordBatch], level=level, k=k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(level.value.has(batch.column(0).to_numpy(), k)))

        # of the keys still in play, those that this level lets pass; the own kind all pass
        wrong = materialise(wrong.mapInArrow(passing, "key long, listed boolean"), "cascade-level")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is missing."""
    text = F.coalesce(url, F.lit(""))
    cut = F.locate("://", text)
    rest = F.when(cut > 0, F.substring(text, cut + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def listed_hosts(hosts: DataFrame, words: tuple[str, ...] = LISTED_WORDS) -> DataFrame:
    """The hosts with one of the words between dots or dashes: a stand-in for a domain list."""
    return hosts.where(F.col("host").rlike(r"(^|[.-])(" + "|".join(words) + r")([.-]|$)")).select("host").distinct()


def filtered(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, listed: DataFrame | None = None, url: str = "url", rate: float = RATE, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with
    its path; the longest one (host and path together, then the later in order) wins and gives the
    verdict.  Else the page is blocked if its host or a domain above it is listed (``listed`` has
    a column ``host``; by default those of the corpus with one of ``LISTED_WORDS``), and allowed
    otherwise.  Whether a key is a rule or is listed is read from one cascade over all keys that
    the pages ask about.

    A null url or one without ``://`` has empty host and path, fits no rule and is allowed.  All
    rows stay, repeated ones too; input columns named like results are replaced, others stay; an
    empty table gives an empty result.  Urls of any length are read whole, in linear time for each
    number of labels that listed hosts have.
    """
    spark = pages.sparkSession
    names = ["host", "path", "rule", "verdict"]
    kept = without(pages, names)
    host, path = host_and_path(F.col(url))
    df = pages.select(*kept, host.alias("host"), path.alias("path"))
    plain = pages.select(host.alias("host"), path.alias("path"))

    if listed is None:
        listed = listed_hosts(plain.select("host").distinct())
    # label counts of the listed hosts: a few small numbers
    counts = [r[0] for r in listed.select(_labels(F.col("host")).alias("n")).distinct().orderBy("n").collect()]
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    rule_keys = [F.concat(F.lit("rule:"), F.substring_index("host", ".", -n), F.substring("path", 1, m)) for n in labels for m in lengths]
    some = F.filter(F.array(*map(F.lit, counts)) if counts else F.array().cast("array<int>"), lambda n: n <= _labels(F.col("host")))
    hosts = F.transform(some, lambda n: F.concat(F.lit("host:"), F.call_function("substring_index", F.col("host"), F.lit("."), -n)))
    none = F.array().cast("array<string>")
    with_host = lambda x: F.when(F.col("host") != "", x).otherwise(none)
    asked = with_host(F.concat(F.array(*rule_keys), hosts))

    keys = [f"rule:{h}{p}" for _, h, p in rules]
    on_list = spark.createDataFrame([(k,) for k in keys], "key string").union(listed.select(F.concat(F.lit("host:"), F.col("host"))))
    universe = plain.select(F.explode(asked).alias("key"))
    both = on_list.select("key", F.lit(True).alias("listed")).union(universe.select("key", F.lit(False).alias("listed")))
    seed = 0
    while True:
        hashed = _hash_with(seed)
        check = F.xxhash64("key", F.lit("check"))
        gathered = both.groupBy(hashed(F.col("key")).alias("key")).agg(F.max("listed").alias("listed"), F.min(check).alias("one"), F.max(check).alias("other"))
        labelled = materialise(gathered, "cascade-keys")
        if labelled.where("listed AND one <> other").isEmpty():
            labelled = labelled.select("key", "listed")
            break
        seed += 1
    # about 1.44 log2(1 / rate) bits a key at level 0, and as many again for all levels after it
    n = labelled.where("listed").count()
    parts = max(1, -(-int(n * 2 * 1.44 * np.log2(2 / rate)) // (8 * most_bytes)))
    df = df.withColumn("__asked", F.array_distinct(F.transform(asked, hashed))).withColumn("__is", F.transform("__asked", lambda k: F.lit(False)))
    for part in range(parts):
        own = labelled if parts == 1 else labelled.where(F.pmod(F.col("key"), F.lit(parts)) == part)
        df = _answered(df, Cascade(build(own, rate).levels), parts, part)
    df = df.withColumn("__yes", F.filter(F.arrays_zip(F.col("__asked").alias("k"), F.col("__is").alias("y")), lambda x: x["y"])).withColumn("__yes", F.transform("__yes", lambda x: x["k"]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = F.array_contains("__yes", hashed(F.lit(f"rule:{h}{p}")))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    found = F.arrays_overlap("__yes", F.transform(with_host(hosts), hashed))
    return df.select(*kept, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(found, "block").otherwise("allow")).alias("verdict"))


def _hash_with(seed: int):
    return lambda k: F.xxhash64(F.lit(seed), k)


def _labels(host: Column) -> Column:
    """How many labels a host has."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _answered(df: DataFrame, cascade: Cascade, parts: int, part: int) -> DataFrame:
    """``df`` with ``__is`` set for those ``__asked`` keys of the part that the cascade has."""
    shared = df.sparkSession.sparkContext.broadcast(cascade)
    at = df.columns.index("__asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, known = batch.column(at), batch.column(at + 1)
            keys = asked.flatten().to_numpy(zero_copy_only=False)
            own = np.flatnonzero(np.mod(keys, parts) == part) if parts > 1 else np.arange(len(keys))
            said = np.array(known.flatten().to_numpy(zero_copy_only=False), bool)
            said[own] |= shared.value.has(keys[own].astype(np.int64))
            offsets = np.concatenate([[0], np.cumsum(np.asarray(asked.value_lengths().fill_null(0)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[: at + 1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(said))], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)
