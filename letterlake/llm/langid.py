"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A word's
probability under a language is the sum over all ways to cut it into pieces, computed with the
forward algorithm; a text's is the product over its words.  Piece probabilities are learned by
expectation maximisation: expected counts of each piece over all cuts, from forward and backward
sums, added up by Spark per language and piece.

Within a task the distinct words of a batch are scored once, position by position for all words
at the same time; sums of long words are scaled as they go, forward and backward, so words of any
length are scored and learned from.  Every piece of the vocabulary is used, whatever its length.
Only the vocabulary and one probability per piece and language are broadcast.

The learning sample is bounded per language, so a rare language is learned from all it has.
Expected counts are added as whole multiples of ``GRAIN``, so that no order of adding changes them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterlake.llm.common import Words, chunks, materialise, without

#: Labelled documents of each language that are learned from at most, about: those with the smallest digests of their texts.
MOST_DOCS = 8_000
#: Languages that are learned at most; more are refused.
MOST_LANGUAGES = 2_000
#: Digests are told apart in this many steps: the sample bound never rounds to nothing.
STEPS = 1 << 62
#: Step of the expected counts that tasks hand back.
GRAIN = 1e-6
#: Rounds of expectation maximisation.
ROUNDS = 3
#: Added to every expected count.
SMOOTHING = 0.1
#: Probability of a character that no piece covers, in every language.
FOREIGN = 1e-6
#: Characters of the longest word whose sums need no scaling.
TOGETHER = 40
#: Characters beyond which a word is scored and learned from in parts of this many, each a word of its own: no cut into
#: pieces then crosses those places, and a text without a border takes no step per character.
PART = 1_024
#: Numbers that a task keeps of the words it has scored.
MOST_KEPT = 4_000_000
UNKNOWN = "und"
_MARK = "▁"


def pieces(path: str | None = None) -> list[str]:
    """The lower-case pieces of a public sentencepiece vocabulary; by default one that is installed."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted({p.lower() for p in own if p})


class Vocabulary:
    """Pieces as a tree of code points: sorted keys of node and code point lead to the next node."""

    def __init__(self, names: list[str]):
        self.names = names
        #: Characters of the longest piece.
        self.longest = max(map(len, names), default=1)
        steps: dict[tuple[int, int], int] = {}
        ends = {0: -1}
        for number, name in enumerate(names):
            node = 0
            for c in name:
                node = steps.setdefault((node, ord(c)), len(steps) + 1)
            ends[node] = number
        order = sorted(steps)
        self.keys = np.array([n << 21 | c for n, c in order], np.int64)
        self.next = np.array([steps[k] for k in order], np.int64)
        self.piece = np.array([ends.get(n, -1) for n in range(len(steps) + 1)], np.int64)

    def edges(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in words (each from ``starts`` to ``ends``): word, begin, size and piece, in place order."""
        word = np.repeat(np.arange(len(starts)), ends - starts)
        at = np.arange(len(word)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts) + np.repeat(starts, ends - starts)
        node = np.zeros(len(at), np.int64)
        out = []
        for depth in range(self.longest):
            if not len(at):
                break
            inside = at + depth < ends[word]
            word, at, node = word[inside], at[inside], node[inside]
            key = node << 21 | points[at + depth]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            word, at, node = word[hit], at[hit], self.next[place[hit]]
            piece = self.piece[node]
            full = piece >= 0
            out.append((word[full], at[full], np.full(full.sum(), depth + 1), piece[full]))
        none = (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(none, *out))


@dataclass
class Model:
    languages: list[str]
    vocabulary: Vocabulary
    #: Probability of each piece (rows) in each language.
    chance: np.ndarray

    def forward(self, words: list[str], expected: bool = False) -> tuple[np.ndarray, list]:
        """Log probability of each word under each language.  With ``expected`` also, per group of words: word, piece
        and share of each language's cuts that have the piece there."""
        shares: list = []
        parts, owner = words, np.arange(len(words))
        if any(len(w) > PART for w in words):
            cut = [[w[k : k + PART] for k in range(0, max(len(w), 1), PART)] for w in words]
            parts, owner = [p for c in cut for p in c], np.repeat(owner, [len(c) for c in cut])
        each = np.zeros((len(parts), len(self.languages)))
        sizes = np.array([len(w) + 1 for w in parts], np.int64)
        order = np.argsort(sizes, kind="stable")
        for lo, hi in _runs(sizes[order], len(self.languages)):
            which = order[lo:hi]
            group = [parts[i] for i in which]
            if sizes[which[-1]] <= TOGETHER:
                self._short(which, group, each, shares if expected else None)
            else:
                self._long(which, group, each, shares if expected else None)
        if parts is words:
            return each, shares
        out = np.zeros((len(words), len(self.languages)))
        np.add.at(out, owner, each)
        return out, [(owner[word], piece, share) for word, piece, share in shares]

    def _laid_out(self, words: list[str]) -> tuple:
        """Sizes, and all pieces sorted by end and size with the bounds of each end and size."""
        points = np.frombuffer((_MARK + _MARK.join(words)).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        ends = np.cumsum(sizes)
        word, at, size, piece = self.vocabulary.edges(points, ends - sizes, ends)
        end = at - (ends - sizes)[word] + size
        place = end * (self.vocabulary.longest + 1) + size
        order = np.argsort(place, kind="stable")
        edge = np.searchsorted(place[order], np.arange((int(sizes.max()) + 1) * (self.vocabulary.longest + 1) + 1))
        return sizes, word[order], end[order], size[order], piece[order], edge

    def _short(self, which: np.ndarray, words: list[str], out: np.ndarray, shares: list | None) -> None:
        """Plain sums: even ``FOREIGN`` to the power of ``TOGETHER`` is a normal number."""
        longest = self.vocabulary.longest
        sizes, word, end, size, piece, edge = self._laid_out(words)
        width, last = int(sizes.max()), (sizes, np.arange(len(words)))
        chance = self.chance[piece]
        steps = [(j, s, edge[j * (longest + 1) + s], edge[j * (longest + 1) + s + 1]) for j in range(1, width + 1) for s in range(1, min(j, longest) + 1)]
        steps = [x for x in steps if x[2] < x[3]]
        ahead = np.zeros((width + 1, len(words), len(self.languages)))
        ahead[0] = 1
        at = 0
        for j in range(1, width + 1):
            np.multiply(ahead[j - 1], FOREIGN, out=ahead[j])
            while at < len(steps) and steps[at][0] == j:
                _, s, a, b = steps[at]
                w = word[a:b]
                ahead[j, w] += ahead[j - s, w] * chance[a:b]
                at += 1
        out[which] = np.log(ahead[last])
        if shares is None:
            return
        behind = np.zeros_like(ahead)
        behind[last] = 1
        for j in range(width, 0, -1):
            behind[j - 1] += behind[j] * FOREIGN
            while at and steps[at - 1][0] == j:
                at -= 1
                _, s, a, b = steps[at]
                w = word[a:b]
                behind[j - s, w] += behind[j, w] * chance[a:b]
        shares.append((which[word], piece, ahead[end - size, word] * chance * behind[end, word] / ahead[last][word]))

    def _long(self, which: np.ndarray, words: list[str], out: np.ndarray, shares: list | None) -> None:
        """Sums scaled at each character: a row is kept relative to its largest number, whose logarithm is kept apart.

        Without ``shares`` only as many characters as the longest piece has are kept.
        """
        longest = self.vocabulary.longest
        sizes, word, end, size, piece, edge = self._laid_out(words)
        width, n = int(sizes.max()), len(words)
        kept = width + 1 if shares is not None else longest + 1
        ring = np.zeros((kept, n, len(self.languages)))
        scale = np.zeros((kept, n, 1))
        ring[0] = 1
        for j in range(1, width + 1):
            now, before = j % kept, (j - 1) % kept
            ring[now] = ring[before] * FOREIGN
            for s in range(1, min(j, longest) + 1):
                a, b = edge[j * (longest + 1) + s], edge[j * (longest + 1) + s + 1]
                if a < b:
                    w, back = word[a:b], (j - s) % kept
                    ring[now, w] += ring[back, w] * self.chance[piece[a:b]] * np.exp(scale[back, w] - scale[before, w])
            top = np.maximum(ring[now].max(axis=1, keepdims=True), 1e-300)
            scale[now] = scale[before] + np.log(top)
            ring[now] /= top
            done = np.flatnonzero(sizes == j)
            out[which[done]] = np.log(np.maximum(ring[now, done], 1e-300)) + scale[now, done]
        if shares is None:
            return
        # the same from the end: behind[j] stands for the cuts of what follows character j
        behind, low = np.zeros_like(ring), np.zeros_like(scale)
        by_begin = np.argsort((end - size) * (longest + 1) + size, kind="stable")
        begins = np.searchsorted((end - size)[by_begin], np.arange(width + 2))
        behind[sizes, np.arange(n)] = 1
        for j in range(width - 1, -1, -1):
            open_ = np.flatnonzero(sizes > j)
            behind[j, open_] = behind[j + 1, open_] * FOREIGN
            low[j, open_] = low[j + 1, open_]
            own = by_begin[begins[j] : begins[j + 1]]
            for s in np.unique(size[own]):
                e = own[size[own] == s]
                w = word[e]
                behind[j, w] += behind[j + s, w] * self.chance[piece[e]] * np.exp(low[j + s, w] - low[j + 1, w])
            top = np.maximum(behind[j, open_].max(axis=1, keepdims=True), 1e-300)
            low[j, open_] += np.log(top)
            behind[j, open_] /= top
        total = np.log(np.maximum(ring[sizes, np.arange(n)], 1e-300)) + scale[sizes, np.arange(n)]
        # a part of the edges at a time
        for lo in range(0, len(piece), 200_000):
            e = slice(lo, lo + 200_000)
            w = word[e]
            log = scale[(end - size)[e], w] + low[end[e], w] - total[w]
            shares.append((which[w], piece[e], ring[(end - size)[e], w] * self.chance[piece[e]] * behind[end[e], w] * np.exp(log)))


class Scorer:
    """Scores texts, with the scores of words that have been met kept up to ``MOST_KEPT`` numbers."""

    def __init__(self, model: Model):
        self.model = model
        self.known = pa.array([], pa.large_string())
        self.table = np.zeros((0, len(model.languages)))

    def scores(self, column: pa.Array) -> np.ndarray:
        """Log probability of each text of a column under each language."""
        words = Words(column)
        coded = words.array.dictionary_encode()
        names = coded.dictionary
        place = pc.index_in(names, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        each = np.zeros((len(names), len(self.model.languages)))
        each[place >= 0] = self.table[place[place >= 0]]
        if len(new):
            fresh = names.take(pa.array(new))
            each[new], _ = self.model.forward(fresh.to_pylist())
            if (len(self.known) + len(new)) * len(self.model.languages) <= MOST_KEPT:
                self.known = pa.concat_arrays([self.known, fresh])
                self.table = np.concatenate([self.table, each[new]])
        total = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each[coded.indices.to_numpy()] if len(coded) else each[:0], axis=0)])
        return total[words.bounds[1:]] - total[words.bounds[:-1]]


def _runs(sizes: np.ndarray, languages: int) -> Iterator[tuple[int, int]]:
    """Ranges of sorted sizes: at most about twice the smallest each, and few enough to keep tables small."""
    numbers = 400_000 * 16 // max(languages, 16)
    lo, n = 0, len(sizes)
    while lo < n:
        most = min(TOGETHER, max(8, int(sizes[lo]) * 2)) if sizes[lo] <= TOGETHER else int(sizes[lo]) * 2
        hi = int(np.searchsorted(sizes, most, "right"))
        hi = max(lo + 1, min(hi, lo + max(1, numbers // most)))
        yield lo, hi
        lo = hi


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learned(labelled: DataFrame, text: str = "text", lang: str = "lang", names: list[str] | None = None, rounds: int = ROUNDS, most_docs: int = MOST_DOCS) -> Model:
    """The model of ``labelled`` texts.  Null texts and languages, and texts without a letter, are left out.

    Of a language with more than ``most_docs`` documents about that many are used, those with the
    smallest digests of their texts (copies of a text are in or out together); of the others all.
    """
    docs = labelled.where(F.col(lang).isNotNull() & has_letter(F.col(text))).select(F.lower(text).alias("text"), F.col(lang).alias("lang"))
    # one row per language; a column of labels with more values than languages is refused, not cut
    found = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = [r[0] for r in found]
    # the digests of each language up to its bound, as a table of at most MOST_LANGUAGES rows
    bounds = docs.sparkSession.createDataFrame([(name, None if n <= most_docs else STEPS * most_docs // n) for name, n in found], "lang string, below long")
    docs = docs.join(F.broadcast(bounds), "lang").where(F.col("below").isNull() | (F.shiftrightunsigned(F.xxhash64("text"), 2) < F.col("below"))).select("text", "lang")
    words = docs.mapInArrow(_counted_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialise(words, "langid-words")
    vocabulary = Vocabulary(pieces() if names is None else names)
    chance = np.full((len(vocabulary.names), len(languages)), 1 / max(len(vocabulary.names), 1))
    model = Model(languages, vocabulary, chance)
    for _ in range(rounds if languages else 0):
        shared = docs.sparkSession.sparkContext.broadcast(model)
        counts = words.mapInArrow(lambda batches, s=shared: _expected(batches, s.value), "lang int, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        table = np.full_like(chance, SMOOTHING)
        # one number per piece and language
        for row in counts.toLocalIterator():
            table[row[1], row[0]] += row[2] * GRAIN
        model = Model(languages, vocabulary, table / table.sum(axis=0))
    return model


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each language has each word, added up for each piece of the input."""
    for batch in batches:
        for lo, hi in chunks(batch.column(0), 8_000_000):
            words = Words(batch.column(0).slice(lo, hi - lo))
            lang = batch.column(1).slice(lo, hi - lo).take(pa.array(words.rows()))
            table = pa.table({"lang": lang, "word": words.array.cast(pa.string())}).group_by(["lang", "word"]).aggregate([([], "count_all")])
            yield from table.select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"]).to_batches()


def _expected(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Expected counts of the pieces of each language: one row per piece and language a task."""
    total = np.zeros_like(model.chance)
    place = pa.array(model.languages, pa.string())
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(1).dictionary_encode()
        lang = pc.index_in(batch.column(0), value_set=place).to_numpy(zero_copy_only=False).astype(np.int64)
        times = np.zeros((len(names.dictionary), len(model.languages)))
        np.add.at(times, (names.indices.to_numpy(), lang), batch.column(2).to_numpy())
        _, shares = model.forward(names.dictionary.to_pylist(), True)
        for word, piece, share in shares:
            for k in range(len(model.languages)):
                total[:, k] += np.bincount(piece, np.rint(share[:, k] * times[word, k] / GRAIN), len(total))
    piece, lang = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, lang].astype(np.int64))], names=["lang", "piece", "n"])


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, without the text.

    Whole texts of any length are read, and words of any length scored.  ``score`` is the share of
    the predicted language in the sum over languages of the text's probabilities.  Ties go to the first language in order.  Null texts, those without a letter,
    and all texts where nothing was learned, are ``und`` with score 0.  Every row, repeated ones
    too, gets its own result; input columns named like results are replaced, others stay.  An empty
    table gives an empty result.
    """
    kept = [c for c in without(docs, ["lang_pred", "score"]) if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model)
        names = pa.array([*model.languages, UNKNOWN], pa.string())
        for batch in batches:
            for lo, hi in chunks(batch.column(0), 8_000_000):
                piece = batch.slice(lo, hi - lo)
                letters = np.asarray(piece.column(1).to_numpy(zero_copy_only=False), bool)
                best = np.full(len(piece), len(model.languages))
                score = np.zeros(len(piece))
                if model.languages:
                    logs = scorer.scores(piece.column(0))
                    best = np.where(letters, logs.argmax(axis=1), best)
                    score = np.where(letters, 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([*piece.columns[2:], names.take(pa.array(best)), pa.array(score)], names=[*kept, "lang_pred", "score"])

    letters = has_letter(F.col(text))
    # whole texts; those without letters need no scoring
    return docs.select(F.when(letters, F.lower(text)).alias("__text"), letters.alias("__letters"), *kept).mapInArrow(run, schema)


def log_probability(word: str, chance: dict[str, float]) -> float:
    """The forward sum of one word in plain Python, for tests."""
    full = _MARK + word
    sums = [1.0] + [0.0] * len(full)
    for j in range(1, len(full) + 1):
        sums[j] = sums[j - 1] * FOREIGN + sum(sums[j - s] * chance.get(full[j - s : j], 0.0) for s in range(1, j + 1))
    return math.log(sums[-1])
