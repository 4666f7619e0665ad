"""Phrase collocation mining by Suffix-sigma.

Every word of a piece of text starts a suffix, truncated to ``max_words`` words.  Suffixes are
shuffled by language and first word, sorted reverse-lexicographically, and one stack counts all
their prefixes: a prefix that the next suffix lacks is complete and leaves the stack.  The parts of
the counted phrases are joined afterwards.

Before the shuffle, suffixes end where a word stands that is too rare for any phrase, and equal
ones of a task's chunk are added up.  Words are coded in two or three bytes by a table of the most
frequent ones; it has at most ``TABLE_WORDS`` words of at most ``TABLE_BYTES`` bytes, and frequent
words that it lacks are spelt out, so nothing depends on its size.  First words that stand in much
of the text are cut further by their next words: suffixes are dealt out in ranges between
quantiles of a sample, and phrases that lie across the border of two ranges are added up
afterwards.  The sample decides only who counts, never what is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from letterlake.llm.common import chunks, discard, materialise, spread_join, utf8

#: Words of the longest phrase, occurrences of a phrase that counts, and phrases returned for a language.
MAX_WORDS, LEAST, TOP = 5, 100, 2_000
#: Most words of the broadcast table, bytes of each and of all, and languages that have a code of their own.
TABLE_WORDS, TABLE_BYTES, LANGUAGES = 1_000_000, 32_000_000, 10_000
WORD_BYTES = 64
#: One suffix of so many is drawn for the ranges, and the most of them that are looked at; ranges per partition.
EVERY, SAMPLE, RANGES = 1_024, 100_000, 8
#: Text bytes that a task turns into suffixes at once.
TEXT_BYTES = 3_000_000
#: First byte of what is spelt out and the byte after it, and bytes of a suffix by which its range is found.
SPELT, END, HEAD = b"\xff", b" ", 12
#: Numbers that have two bytes, the first below 0x80; others have three.
SHORT = 1 << 15

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[[0x20, 0x09]] = True


class Tokens:
    """The words of some texts: ``array`` in order, ``row`` of each, and ``piece``, which differs where a piece ends."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8(column)
        inside = ~_OUTSIDE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        places = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=places[1:])
        self.array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(_FOLD[data[inside]])])
        bounds = np.searchsorted(starts, offsets)
        self.row = np.repeat(np.arange(len(column)), np.diff(bounds))
        # breaks so far, and rows so far
        self.piece = np.cumsum(_BREAK[data])[starts] + self.row


def _languages(column: pa.Array) -> pa.DictionaryArray:
    return column.fill_null("und").dictionary_encode()


def _tallied(batches: Iterator[pa.RecordBatch], max_words: int) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> lang, word, n; and some suffixes (``drawn``), their words joined by blanks."""
    for batch in batches:
        for lo, hi in chunks(batch.column(1), TEXT_BYTES):
            tokens = Tokens(batch.column(1).slice(lo, hi - lo))
            lang = _languages(batch.column(0).slice(lo, hi - lo))
            words = tokens.array.dictionary_encode()
            own = lang.indices.to_numpy().astype(np.int64)[tokens.row]
            pairs, n = np.unique(own * max(len(words.dictionary), 1) + words.indices.to_numpy(), return_counts=True)
            langs, which = np.divmod(pairs, max(len(words.dictionary), 1))
            rows = [(lang.dictionary.take(pa.array(langs)), words.dictionary.take(pa.array(which)).cast(pa.binary()), n, False)]
            at = np.arange(EVERY // 2, len(own), EVERY)
            if len(at):
                parts = [_shifted(tokens.array, tokens.piece, at, k) for k in range(max_words)]
                rows.append((lang.dictionary.take(pa.array(own[at])), pc.binary_join_element_wise(*parts, pa.scalar(END, pa.large_binary()), null_handling="skip").cast(pa.binary()), np.ones(len(at), np.int64), True))
            for a, b, c, drawn in rows:
                yield pa.RecordBatch.from_arrays([a.cast(pa.string()), b.cast(pa.string()), pa.array(c), pa.array(np.full(len(a), drawn))], names=["lang", "word", "n", "drawn"])


def _shifted(values: pa.Array, piece: np.ndarray, at: np.ndarray, k: int, stop: np.ndarray | None = None) -> pa.Array:
    """For each place ``at`` the value ``k`` words on, or null beyond its piece (or beyond ``stop``)."""
    on = np.minimum(at + k, len(piece) - 1)
    fits = (at + k < len(piece)) & (piece[on] == piece[at])
    if stop is not None:
        fits &= at + k < stop[at]
    return values.take(pa.array(on, mask=~fits))


class Coder:
    """Suffixes as bytes: language, then words; each a code of two or three bytes, or spelt out between ``SPELT`` and ``END``.

    The first byte tells how long a code is and no word has a blank, so no code is the beginning of another, and suffixes with a common beginning of words lie together when sorted.
    """

    def __init__(self, words: list[str], complete: bool, languages: list[str], drawn: list[tuple[str, str]], ranges: int):
        self.words = pa.array([w.encode() for w in words], pa.large_binary())
        #: Whether all other words are too rare for any phrase.
        self.complete = complete
        self.languages = pa.array(languages, pa.string())
        heads = np.sort(self.heads(self.joined([lang for lang, _ in drawn], [s.split(" ") for _, s in drawn]))) if drawn else np.zeros(0, f"S{HEAD}")
        self.borders = np.unique(heads[np.linspace(0, len(heads), ranges + 1).astype(int)[1:-1]]) if len(heads) else heads

    @staticmethod
    def codes(numbers: np.ndarray) -> pa.Array:
        """Two bytes each, or three; null below zero."""
        sizes = np.where(numbers < 0, 0, np.where(numbers < SHORT, 2, 3))
        places = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(sizes, out=places[1:])
        out = np.zeros(places[-1], np.uint8)
        for size, first in ((2, 0), (3, 0x80 << 16)):
            rows = np.flatnonzero(sizes == size)
            for k in range(size):
                out[places[rows] + k] = (numbers[rows] + first >> 8 * (size - 1 - k)) & 0xFF
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(numbers), [None, pa.py_buffer(places), pa.py_buffer(out)])
        return pc.if_else(pa.array(numbers >= 0), found, pa.scalar(None, pa.large_binary()))

    def coded(self, words: pa.Array) -> pa.Array:
        """Codes of words; null for words that are too rare."""
        found = self.codes(pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False))
        if self.complete:
            return found
        return pc.coalesce(found, pc.binary_join_element_wise(pa.scalar(SPELT, pa.large_binary()), words, pa.scalar(END, pa.large_binary()), pa.scalar(b"", pa.large_binary())))

    def coded_languages(self, names: pa.Array) -> pa.Array:
        found = self.codes(pc.index_in(names.cast(pa.string()), value_set=self.languages).fill_null(-1).to_numpy(zero_copy_only=False))
        # in hexadecimal, because names may have blanks
        spelt = pa.array([SPELT + x.encode().hex().encode() + END for x in names.to_pylist()], pa.large_binary())
        return pc.coalesce(found, spelt)

    def joined(self, languages: list[str], suffixes: list[list[str]]) -> pa.Array:
        sizes = [len(words) for words in suffixes]
        langs = self.coded_languages(pa.array(languages, pa.string())).to_pylist()
        codes = self.coded(pa.array([w.encode() for words in suffixes for w in words], pa.large_binary())).to_pylist()
        out, at = [], 0
        for lang, size in zip(langs, sizes):
            own = codes[at : at + size]
            out.append(lang + b"".join(own[: own.index(None)] if None in own else own))
            at += size
        return pa.array(out, pa.large_binary())

    @staticmethod
    def heads(keys: pa.Array) -> np.ndarray:
        _, places, data = keys.buffers()
        offsets = np.frombuffer(places, np.int64)[keys.offset : keys.offset + len(keys) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        out = np.zeros((len(keys), HEAD), np.uint8)
        for k in range(HEAD):
            has = np.flatnonzero(offsets[:-1] + k < offsets[1:])
            out[has, k] = data[offsets[:-1][has] + k]
        return out.reshape(-1).view(f"S{HEAD}")

    def suffixes(self, lang: pa.DictionaryArray, tokens: Tokens, max_words: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Range, key and number of the different suffixes of at least two words."""
        if not len(tokens.array):
            return np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(0, np.int64)
        words = tokens.array.dictionary_encode()
        own = self.coded(words.dictionary)
        known = ~np.asarray(own.is_null())[words.indices.to_numpy()]
        # where the first word at or after each place is too rare
        stop = np.append(np.where(known, len(known), np.arange(len(known))), len(known))
        stop = np.minimum.accumulate(stop[::-1])[::-1]
        on = np.minimum(np.arange(len(known)) + 1, len(known) - 1)
        at = np.flatnonzero(known & known[on] & (on > np.arange(len(known))) & (tokens.piece[on] == tokens.piece))
        codes = own.take(words.indices)
        first = self.coded_languages(lang.dictionary).take(pa.array(lang.indices.to_numpy()[tokens.row[at]]))
        parts = [_shifted(codes, tokens.piece, at, k, stop) for k in range(max_words)]
        found = pc.binary_join_element_wise(first, *parts, pa.scalar(b"", pa.large_binary()), null_handling="skip").value_counts()
        keys, heads = found.field(0), self.heads(found.field(0))
        # neighbours that begin alike take less room in the shuffle
        order = np.argsort(heads.view(np.uint8).reshape(-1, HEAD)[:, :8].copy().view(">u8").ravel().astype(np.uint64), kind="stable")
        return np.searchsorted(self.borders, heads[order], "right"), keys.take(pa.array(order)), found.field(1).to_numpy()[order]

    def parsed(self, keys: pa.Array, max_words: int) -> tuple[np.ndarray, pa.Array]:
        """Numbers of language and words of each key (0: none), and the spelt ones, numbered from 2 ** 24."""
        _, places, data = keys.buffers()
        offsets = np.frombuffer(places, np.int64)[keys.offset : keys.offset + len(keys) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        ends = np.flatnonzero(data == END[0])
        at, out, spelt = offsets[:-1].copy(), np.zeros((len(keys), max_words + 1), np.int64), []
        for d in range(max_words + 1):
            live = np.flatnonzero(at < offsets[1:])
            literal = data[at[live]] == SPELT[0]
            some = live[~literal]
            short = data[at[some]] < 0x80
            wide, some = some[~short], some[short]
            out[some, d] = (data[at[some]].astype(np.int64) << 8 | data[at[some] + 1]) + 1
            out[wide, d] = ((data[at[wide]].astype(np.int64) & 0x7F) << 16 | data[at[wide] + 1].astype(np.int64) << 8 | data[at[wide] + 2]) + 1
            at[some] += 2
            at[wide] += 3
            for row in live[literal].tolist():
                end = int(ends[np.searchsorted(ends, at[row])])
                out[row, d] = (1 << 24) + len(spelt)
                spelt.append(data[at[row] + 1 : end].tobytes())
                at[row] = end + 1
        if spelt:
            encoded = pa.array(spelt, pa.large_binary()).dictionary_encode()
            far = out >= 1 << 24
            out[far] = (1 << 24) + encoded.indices.to_numpy()[out[far] - (1 << 24)]
            return out, encoded.dictionary
        return out, pa.array([], pa.large_binary())

    def phrases(self, numbers: np.ndarray, spelt: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Languages and phrases of rows of ``parsed``."""
        table = pa.concat_arrays([self.words, spelt])

        def words(column: np.ndarray) -> pa.Array:
            at = np.where(column >= 1 << 24, column - (1 << 24) + len(self.words), column - 1)
            return table.take(pa.array(at, mask=column == 0))

        langs = self.languages.to_pylist()
        names = {x: langs[x - 1] if x < 1 << 24 else bytes.fromhex(spelt[x - (1 << 24)].as_py().decode()).decode() for x in np.unique(numbers[:, 0]).tolist()}
        joined = pc.binary_join_element_wise(*(words(numbers[:, d]) for d in range(1, numbers.shape[1])), pa.scalar(END, pa.large_binary()), null_handling="skip")
        return pa.array([names[x] for x in numbers[:, 0].tolist()], pa.string()), joined.cast(pa.binary()).cast(pa.string())


def _emitted(batches: Iterator[pa.RecordBatch], coder: Coder, max_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in chunks(batch.column(1), TEXT_BYTES):
            tokens = Tokens(batch.column(1).slice(lo, hi - lo))
            part, keys, n = coder.suffixes(_languages(batch.column(0).slice(lo, hi - lo)), tokens, max_words)
            # some at once, so that no batch passes what Arrow's offsets can say
            for at in range(0, len(keys), 100_000):
                piece = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(part[piece].astype(np.int32)), keys[piece].cast(pa.binary()), pa.array(n[piece])], names=["part", "suffix", "n"])


def _counted(batches: Iterator[pa.RecordBatch], coder: Coder, max_words: int, least: int) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes -> lang, phrase, size and n of their prefixes of two words or more: those found ``least`` times, and those at the border of a range.

    ``stack`` has the open prefixes of the last suffix by their length: how often each was found,
    and whether its range began with it.
    """
    stack: dict[int, tuple[int, bool]] = {}
    last_key, last_part = None, -1

    def closed(numbers: np.ndarray, spelt: pa.Array, size: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        langs, phrases = coder.phrases(numbers * (np.arange(numbers.shape[1]) <= size[:, None]), spelt)
        return pa.RecordBatch.from_arrays([langs, phrases, pa.array(size.astype(np.int32)), pa.array(n)], names=["lang", "phrase", "size", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(1).cast(pa.large_binary())
        part, n = batch.column(0).to_numpy().astype(np.int64), batch.column(2).to_numpy()
        begins = last_key is None
        if not begins:
            keys = pa.concat_arrays([pa.array([last_key], pa.large_binary()), keys])
            part, n = np.append(last_part, part), np.append(0, n)
        numbers, spelt = coder.parsed(keys, max_words)
        border = np.append(begins, part[1:] != part[:-1])
        other = border.copy()
        other[0] = True
        other[1:] |= numbers[1:, 0] != numbers[:-1, 0]
        out = []
        for d in range(1, max_words + 1):
            other[1:] |= numbers[1:, d] != numbers[:-1, d]
            if d < 2:
                continue
            starts = np.flatnonzero(other)
            own = n.copy()
            at_border = border[starts].copy()
            if not begins:
                own[0], at_border[0] = stack.get(d, (0, False))
            totals = np.add.reduceat(own, starts)
            stack[d] = (int(totals[-1]), bool(at_border[-1]))
            at_border[:-1] |= border[starts[1:]]
            keep = np.flatnonzero((numbers[starts, d] > 0) & (at_border | (totals >= least)))
            keep = keep[keep < len(starts) - 1]
            out.append((starts[keep], np.full(len(keep), d), totals[keep]))
        rows, size, totals = (np.concatenate(x) for x in zip(*out))
        if len(rows):
            yield closed(numbers[rows], spelt, size, totals)
        last_key, last_part = keys[len(keys) - 1].as_py(), int(part[-1])
    if last_key is not None:
        numbers, spelt = coder.parsed(pa.array([last_key], pa.large_binary()), max_words)
        own = [d for d in range(2, max_words + 1) if numbers[0, d] > 0]
        yield closed(np.repeat(numbers, len(own), axis=0), spelt, np.array(own, np.int64), np.array([stack[d][0] for d in own], np.int64))


def tallies(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS) -> DataFrame:
    """``lang``, ``word``, ``n`` of all words (``drawn`` false), and some suffixes."""
    texts = docs.where(F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    found = texts.mapInArrow(lambda batches: _tallied(batches, max_words), "lang string, word string, n long, drawn boolean")
    return found.groupBy("lang", "word", "drawn").agg(F.sum("n").alias("n"))


def coder_of(tallied: DataFrame, least: int, table_words: int, ranges: int) -> Coder:
    """The table of frequent words, the most frequent first, within its bounds; and the ranges."""
    words = tallied.where(~F.col("drawn") & (F.col("n") >= least)).groupBy("word").agg(F.sum("n").alias("n"))
    total = words.count()
    short = words.where(F.octet_length("word") <= WORD_BYTES).orderBy(F.desc("n"), "word").limit(min(table_words, TABLE_BYTES // (WORD_BYTES // 2)))
    table = [r[0] for r in short.select("word").collect()]
    langs = tallied.where("NOT drawn").groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    drawn = tallied.where(F.col("drawn") & (F.octet_length("word") <= WORD_BYTES * MAX_WORDS)).select("lang", "word", F.xxhash64("lang", "word").alias("h")).orderBy("h", "lang", "word").limit(SAMPLE)
    return Coder(table, len(table) == total, [r[0] for r in langs.collect()], [(r[0], r[1]) for r in drawn.collect()], ranges)


def phrase_counts(docs: DataFrame, tallied: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, table_words: int = TABLE_WORDS) -> DataFrame:
    """``lang``, ``phrase``, ``size`` (words) and ``a`` (occurrences) of all phrases of two words or more found ``least`` times."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coder = spark.sparkContext.broadcast(coder_of(tallied, least, table_words, RANGES * partitions))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    suffixes = texts.mapInArrow(lambda batches: _emitted(batches, coder.value, max_words), "part int, suffix binary, n long")
    suffixes = suffixes.repartition(partitions, "part").sortWithinPartitions(F.desc("suffix"))
    found = suffixes.mapInArrow(lambda batches: _counted(batches, coder.value, max_words, least), "lang string, phrase string, size int, n long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def scored(phrases: DataFrame, tallied: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of the phrases that no longer one of the same count contains."""
    totals = tallied.where("NOT drawn").groupBy("lang").agg(F.sum("n").alias("n"))
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).unionByName(tallied.where(~F.col("drawn") & (F.col("n") >= least)).select("lang", F.col("word").alias("part"), F.col("n").alias("f")))
    cuts = phrases.select("lang", "phrase", "size", "a", F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "size", "a", "k", F.explode(F.array(F.struct(F.lit(True).alias("left"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("part")), F.struct(F.lit(False).alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("part")))).alias("s")).select("lang", "phrase", "size", "a", "k", "s.left", "s.part")
    wanted = sides.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("__n"))
    met = spread_join(sides, known.join(wanted, ["lang", "part"]), ["lang", "part"], "__n", sides.count())
    met = materialise(met, "collocations-parts")
    # a phrase lies in a longer one of the same count exactly if it lies in one of a word more
    inner = met.where((F.col("f") == F.col("a")) & (F.col("size") > 2) & (F.col("k") == F.when(F.col("left"), F.col("size") - 1).otherwise(1)))
    inner = inner.select("lang", F.col("part").alias("phrase")).distinct()
    both = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    # languages may be many; their totals are joined as a table
    both = both.join(totals, "lang").withColumn("score", F.expr("(CAST(1000 * CAST(a AS DECIMAL(19,0)) AS DECIMAL(23,0)) * CAST(n AS DECIMAL(15,0))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(18,0)))"))
    best = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.join(inner, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP, table_words: int = TABLE_WORDS) -> DataFrame:
    """The ``top`` collocations of each language: ``lang``, ``rank`` (from 1), ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at blanks and tabs.  ``a``
    is how often the phrase stands in pieces of its language, ``l`` and ``r`` its parts at the cut
    of the lowest score ``1000 * a * n // (l * r)``, ``n`` the words of the language.  Ties go to
    the shortest first part; ranks to score, then ``a``, then the phrase by its bytes.  Null texts
    have no words, texts without a language belong to ``und``; repeated rows count each time;
    further columns are not looked at.  Whole texts of any length are read.  An empty table, or one
    without frequent phrases, gives an empty result.
    """
    tallied = materialise(tallies(docs, text, lang, max_words), "collocations-words")
    phrases = materialise(phrase_counts(docs, tallied, text, lang, max_words, least, table_words), "collocations-phrases")
    found = scored(phrases, tallied, least)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # first within shares of a language, then among what they leave
    for keys in (["lang", "__share"], ["lang"]):
        if len(keys) > 1:
            found = found.withColumn("__share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        found = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    result = found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    result = materialise(result, "collocations")
    for df in (tallied, phrases):
        discard(df)
    return result
