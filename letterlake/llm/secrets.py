"""Secret scans: known forms, and a battery of randomness tests.  DataFrame functions only.

A token is a run of at least ``LEAST`` characters that encodings use.  Its encoding is inferred
from its characters (hexadecimal, upper- or lower-case letters and digits, or base 64; hyphens
that only group hexadecimal digits, as in UUIDs, are left out).  The battery asks whether it looks
drawn at random from that alphabet: chi-squared uniformity of its characters and of their classes
(capitals, small letters, digits), runs of low and high symbols and of classes, and the
correlation of neighbours.

Ordinary tokens pass such tests by chance, the shorter the more often, so each token that passes
has a p-value: how probable it is that an ordinary token of that encoding, length and number of
digits looks as random.  Ordinary tokens are made of the prose of the documents with tokens: words
run together, each with a capital where the encoding has both cases, and the token's own digits
as a number at the end; each token has ``DECOYS`` such decoys.  A score adds up how uneven the
characters and classes are and how rarely classes alternate, which is what sets words and numbers
apart from random characters.  The decoys' scores give mean and spread for each encoding and length
class, drawn towards those of all lengths where decoys are few.  A p-value is the rank of a score
among the decoys, or the normal tail of these moments if that is smaller.
For hexadecimal digits the p-value also has the chance that so many characters of prose are all
digits.  Discoveries are then controlled per encoding and length class by Benjamini and Hochberg's
step at ``FALSE_SHARE``, so a long key counts among thousands of names, a short one only alone.

What is gathered from the corpus is one histogram of scores per encoding and length class.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterlake.llm.common import without
from letterlake.llm.spans import Kind, bound, counted, listed, no_spans, overlaps, placed, replaced, with_spans

LEAST = 16
#: Padding may follow a token, but a sign of equality within ends it.
TOKEN = r"[A-Za-z0-9+/_-]{%d,}+={0,2}" % LEAST
#: Share of false discoveries that a class may have.
FALSE_SHARE = 0.05
#: Decoys of each token.
DECOYS = 12
#: Decoys that the moments of all lengths weigh in a class, and those assumed where an encoding has none.
PRIOR, ASSUMED_MEAN, ASSUMED_VARIANCE = 20, 8.0, 4.0
#: Standard deviations within which a test passes: uniformity (one-sided), runs, correlation, classes (one-sided), their runs.
LIMITS = (3.0, 3.3, 3.3, 3.0, 3.3)
#: What unevenness and few runs of classes weigh in a score, against unevenness of characters.
OF_CLASSES = 1.5
#: Steps per unit of the score's histogram, and its last step.
GRAIN, LAST = 8, 800

_ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = (
    Kind("assign", _ASSIGN, lambda t: t.contains("=") | t.contains(":"), lambda m: F.length(F.regexp_extract(m, _ASSIGN, 2)) >= 8),
    # maximal runs: the least length stands in the pattern
    Kind("access", r"AKIA[A-Z0-9]{12,}", lambda t: t.contains("AKIA"), lambda m: F.lit(True)),
    Kind("hex", r"[0-9a-f]{32,}", lambda t: t.rlike("[0-9a-f]{32}"), lambda m: F.lit(True)),
)


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "hex": _DIGITS + _LOWER[:6],
    "HEX": _DIGITS + _LOWER[:6].upper(),
    "alnum": _DIGITS + _LOWER,
    "ALNUM": _DIGITS + _LOWER.upper(),
    "base64": _LOWER.upper() + _LOWER + _DIGITS + "+/",
}


#: Last symbols of the first and second class of each alphabet (by its size).
CLASSES = {16: (10, 16), 36: (10, 36), 64: (26, 52)}


def plain(token: Column) -> Column:
    """Without padding and without hyphens that group hexadecimal digits, and with the url-safe letters of base 64 as the usual ones."""
    bare = F.rtrim(token, F.lit("="))
    return F.when(token.rlike("^([0-9a-f]+(-[0-9a-f]+)+|[0-9A-F]+(-[0-9A-F]+)+)$"), F.translate(bare, "-", "")).otherwise(F.translate(bare, "-_", "+/"))


def encoding(token: Column) -> Column:
    """The first of ``ALPHABETS`` that has all characters of ``plain(token)``."""
    out = F.lit("base64")
    for name in reversed(list(ALPHABETS)[:-1]):
        out = F.when(F.translate(plain(token), ALPHABETS[name], "") == "", name).otherwise(out)
    return out


def battery(token: Column, name: Column) -> Column:
    """``ok`` (``token``, read in the alphabet ``name``, passes all tests) and ``score`` (the sum of its deviations;
    null where a test cannot be made), in time linear in the token."""
    letters = F.lit(None).cast("string")
    for k, v in ALPHABETS.items():
        letters = F.when(name == k, v).otherwise(letters)
    return bound(F.struct(plain(token).alias("t"), letters.alias("a")), lambda v: _tests(v["t"], v["a"]))


def _tests(t: Column, a: Column) -> Column:
    n, k = F.length(t).cast("double"), F.length(a).cast("double")
    symbols = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.instr(a, c).cast("double"))
    squares = F.aggregate(F.array_distinct(F.split(t, "")), F.lit(0.0), lambda s, c: s + F.pow(F.length(t) - F.length(F.replace(t, c, F.lit(""))), F.lit(2.0)))
    chi, free = squares * k / n - n, k - 1
    # Wilson and Hilferty: the cube root is close to normal
    uniform = (F.cbrt(F.greatest(chi, F.lit(0.0)) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))

    def by_size(value: Callable[[int], float]) -> Column:
        out = F.lit(float(value(64)))
        for size in (16, 36):
            out = F.when(k == size, float(value(size))).otherwise(out)
        return out

    first, second = by_size(lambda size: CLASSES[size][0]), by_size(lambda size: CLASSES[size][1])
    class_of = lambda v: F.when(v <= first, 0).when(v <= second, 1).otherwise(2)

    def of_symbols(x: Column) -> Column:
        sums = F.aggregate(
            x,
            F.struct(*(F.lit(0.0).alias(name) for name in "hsqab")),
            lambda s, v: F.struct((s["h"] + F.when(v > k / 2, 1.0).otherwise(0.0)).alias("h"), (s["s"] + v).alias("s"), (s["q"] + v * v).alias("q"), (s["a"] + F.when(v <= first, 1.0).otherwise(0.0)).alias("a"), (s["b"] + F.when((v > first) & (v <= second), 1.0).otherwise(0.0)).alias("b")),
        )
        pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        both = F.aggregate(
            pairs,
            F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("c"), F.lit(0.0).alias("d")),
            lambda s, v: F.struct((s["r"] + F.when((v["p"] > k / 2) != (v["q"] > k / 2), 1.0).otherwise(0.0)).alias("r"), (s["c"] + v["p"] * v["q"]).alias("c"), (s["d"] + F.when(class_of(v["p"]) != class_of(v["q"]), 1.0).otherwise(0.0)).alias("d")),
        )
        return bound(F.struct(sums.alias("x"), both.alias("b"), uniform.alias("u")), of_sums)

    def of_sums(v: Column) -> Column:
        x = v["x"]
        one = 2 * x["h"] * (n - x["h"])
        runs = F.when(one > n, (v["b"]["r"] - one / n) / F.sqrt(one * (one - n) / (n * n * (n - 1))))
        spread = x["q"] - x["s"] * x["s"] / n
        tied = F.when(spread > 0, (v["b"]["c"] - x["s"] * x["s"] / n) / spread * F.sqrt(n))
        shares = lambda size: [w / size for w in (CLASSES[size][0], CLASSES[size][1] - CLASSES[size][0], size - CLASSES[size][1])]
        uneven, kinds = F.lit(0.0), by_size(lambda size: sum(w > 0 for w in shares(size)) - 1)
        for j, count in enumerate((x["a"], x["b"], n - x["a"] - x["b"])):
            expected = n * by_size(lambda size, j=j: shares(size)[j])
            uneven = uneven + F.when(expected > 0, (count - expected) * (count - expected) / expected).otherwise(0.0)
        classes = (F.cbrt(uneven / kinds) - (1 - 2 / (9 * kinds))) / F.sqrt(2 / (9 * kinds))
        # neighbours of different classes: their mean and variance in independent draws
        differ = by_size(lambda size: 1 - sum(w * w for w in shares(size)))
        together = by_size(lambda size: sum(w * (1 - w) ** 2 for w in shares(size)) - (1 - sum(w * w for w in shares(size))) ** 2)
        turns = (v["b"]["d"] - (n - 1) * differ) / F.sqrt((n - 1) * differ * (1 - differ) + 2 * (n - 2) * together)
        # too few kinds of symbols for a test: not random
        ok = (v["u"] <= LIMITS[0]) & (F.abs(runs) <= LIMITS[1]) & (F.abs(tied) <= LIMITS[2]) & (classes <= LIMITS[3]) & (F.abs(turns) <= LIMITS[4])
        score = v["u"] + OF_CLASSES * (F.greatest(classes, F.lit(0.0)) + F.greatest(-turns, F.lit(0.0)))
        return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), score.alias("score"))

    fits = (n >= LEAST) & (F.translate(t, ALPHABETS["base64"], "") == "")
    none = F.struct(F.lit(False).alias("ok"), F.lit(None).cast("double").alias("score"))
    return F.when(fits, bound(symbols, lambda x: F.when(F.exists(x, lambda y: y == 0), none).otherwise(of_symbols(x)))).otherwise(none)


def looks_random(token: Column, name: Column) -> Column:
    """Whether ``token``, read in the alphabet ``name``, passes the battery; false if it does not fit."""
    return F.coalesce(battery(token, name)["ok"], F.lit(False))


def is_mixed(token: Column) -> Column:
    """A token that may be a secret: with letters and digits."""
    return token.rlike("[0-9]") & token.rlike("[A-Za-z]")


def length_class(token: Column) -> Column:
    """Four classes per power of two of the length."""
    return F.floor(F.log2(F.length(token).cast("double")) * 4).cast("int")


def token_class(token: Column) -> Column:
    return F.concat_ws(":", encoding(token), length_class(plain(token)))


def step(score: Column) -> Column:
    """The histogram step of a score; null, where no test could be made, has the last one."""
    # least and greatest pass over nulls, so these are told apart first
    return F.when(score.isNull() | F.isnan(score), LAST).otherwise(F.least(F.greatest(F.ceil(score * GRAIN), F.lit(-LAST)), F.lit(LAST))).cast("int")


def tokens_of(body: Column) -> Column:
    """The tokens of a text; texts without a digit have no candidates."""
    return F.when(body.rlike("[0-9]"), F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def histogram(docs: DataFrame, text: str = "text") -> DataFrame:
    """class, decoy, ok, step and n of tokens and decoys; and characters of their documents' prose (class ``prose``),
    where ok marks those that are hexadecimal digits."""
    body = F.coalesce(F.col(text), F.lit(""))
    some = docs.select(body.alias("body"), F.filter(tokens_of(body), is_mixed).alias("tokens")).where(F.size("tokens") > 0)
    # words run together, each with a capital; the decoys' digits come from their tokens
    prose = F.regexp_replace(F.initcap(F.regexp_replace(F.regexp_replace("body", TOKEN, ""), "[^A-Za-z]+", " ")), " ", "")
    some = some.select("tokens", prose.alias("prose"))
    # bytes, because a place in a text is found by counting from its beginning
    folded = {"base64": F.col("prose"), "alnum": F.lower("prose"), "ALNUM": F.upper("prose"), "hex": F.regexp_replace(F.lower("prose"), "[^a-f]+", ""), "HEX": F.regexp_replace(F.upper("prose"), "[^A-F]+", "")}
    some = some.select("tokens", *(F.encode(folded[k], "UTF-8").alias(f"as_{i}") for i, k in enumerate(ALPHABETS)))

    def prose_in(name: str) -> Column:
        return F.col(f"as_{list(ALPHABETS).index(name)}")

    def piece(name: str, size: Column, nth: Column) -> Column:
        """The nth piece of the prose, from the start again at its end."""
        own = prose_in(name)
        room = F.length(own) - size + 1
        return F.when(room > 0, F.decode(F.substring(own, F.pmod(nth * size, F.greatest(room, F.lit(1))) + 1, size), "UTF-8"))

    def with_decoys(t: Column, i: Column) -> Column:
        def of(v: Column) -> Column:
            def decoy(k: Column) -> Column:
                out = F.lit(None).cast("string")
                for name in ALPHABETS:
                    out = F.when(v["e"] == name, piece(name, v["n"] - F.length(v["d"]), i * DECOYS + k)).otherwise(out)
                return F.concat(out, v["d"])

            return F.struct(v["e"].alias("e"), v["c"].alias("c"), F.concat(F.array(t), F.transform(F.sequence(F.lit(0), F.lit(DECOYS - 1)), decoy)).alias("all"))

        return bound(F.struct(encoding(t).alias("e"), token_class(t).alias("c"), F.length(plain(t)).alias("n"), F.regexp_replace(t, "[^0-9]+", "").alias("d")), of)

    each = some.select(F.explode(F.transform("tokens", with_decoys)).alias("x")).select("x.e", "x.c", F.posexplode("x.all").alias("nth", "s")).where("s IS NOT NULL")
    each = each.select("c", (F.col("nth") > 0).alias("decoy"), battery(F.col("s"), F.col("e")).alias("b"))
    scores = each.groupBy(F.col("c").alias("class"), "decoy", F.coalesce("b.ok", F.lit(False)).alias("ok"), step(F.col("b.score")).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    letters = some.select(F.explode(F.array(F.struct(F.lit(True).alias("ok"), F.length(prose_in("hex")).alias("n")), F.struct(F.lit(False).alias("ok"), (F.length(prose_in("base64")) - F.length(prose_in("hex"))).alias("n")))).alias("x"))
    letters = letters.groupBy("x.ok").agg(F.sum("x.n").cast("long").alias("n"))
    return scores.unionByName(letters.select(F.lit("prose").alias("class"), F.lit(False).alias("decoy"), "ok", F.lit(0).alias("step"), "n"))


def _moments(counts: list[tuple[int, int]], mean: float, variance: float) -> tuple[float, float]:
    """Mean and variance of a histogram, with ``PRIOR`` values of the given moments added."""
    n = sum(c for _, c in counts) + PRIOR
    middle = (sum(s / GRAIN * c for s, c in counts) + PRIOR * mean) / n
    square = sum((s / GRAIN - middle) ** 2 * c for s, c in counts) + PRIOR * (variance + (mean - middle) ** 2)
    return middle, max(square / n, 1.0)


def accepted(rows: list[tuple[str, bool, bool, int, int]], false_share: float = FALSE_SHARE) -> dict[str, int]:
    """The last step of each class whose passing tokens count, from the rows of ``histogram``."""
    hexadecimal = sum(n for c, _, ok, _, n in rows if c == "prose" and ok)
    prose = sum(n for c, _, _, _, n in rows if c == "prose")
    fitting = (hexadecimal + 1) / (prose + 2)
    decoys: dict[str, list[tuple[int, int]]] = {}
    for c, decoy, _, s, n in rows:
        if decoy and s < LAST:
            decoys.setdefault(c, []).append((s, n))
    out = {}
    for c in sorted({r[0] for r in rows if not r[1]} - {"prose"}):
        name, size = c.split(":")
        whole = _moments([x for k, v in decoys.items() if k.split(":")[0] == name for x in v], ASSUMED_MEAN, ASSUMED_VARIANCE)
        middle, variance = _moments(decoys.get(c, []), *whole)
        chance = fitting ** (2 ** (int(size) / 4)) if name.lower() == "hex" else 1.0
        total = sum(r[4] for r in rows if r[0] == c and not r[1])
        own = sorted(decoys.get(c, []))
        found = 0
        for s, n in sorted((r[3], r[4]) for r in rows if r[0] == c and not r[1] and r[2]):
            found += n
            # by rank among the decoys, or, as no rank says how rare a score beyond them is, by their moments
            rank = (1 + sum(m for t, m in own if t <= s)) / (1 + sum(m for _, m in own))
            p = chance * min(rank, math.erfc((middle - s / GRAIN) / math.sqrt(2 * variance)) / 2)
            if p * total <= false_share * found:
                out[c] = s
    return out


def accepted_classes(docs: DataFrame, text: str = "text") -> list[str]:
    """The classes (encoding and length class) in which some tokens count."""
    return sorted(accepted([tuple(r) for r in histogram(docs, text).collect()]))


def scanned(docs: DataFrame, text: str = "text", keep_text: bool = True, false_share: float = FALSE_SHARE) -> DataFrame:
    """``docs`` with ``base_spans`` of the known forms, ``spans`` (those and ``random`` ones) and ``redacted``.

    Spans have start, rank, end (code points, end exclusive), kind and match, and are sorted by
    start and kind.  A random span never overlaps one of a known form.  ``redacted`` is the text
    with each span replaced by its kind in brackets; ``keep_text=False`` leaves both texts out.
    Null and empty texts have no spans (``redacted`` of null is null), and so has an empty table no
    rows.  Every row, repeated ones too, gets its own result, and equal scores are accepted or not
    together; input columns named like results are replaced, others stay.  Whole texts and tokens
    of any length are read, in linear time.
    """
    # a bounded table: encodings, length classes and steps
    steps = accepted([tuple(r) for r in histogram(docs, text).collect()], false_share)
    names = ["base_spans", "spans", "redacted"]
    kept = [c for c in without(docs, names) if keep_text or c != text]
    df = with_spans(docs.select(*dict.fromkeys([*kept, text])), text, KINDS, "base_spans")
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__tokens", tokens_of(body) if steps else F.array().cast("array<string>"))
    df = df.withColumn("__some", F.exists("__tokens", is_mixed))
    df = df.withColumn("__all", F.when(F.col("__some"), placed(body, TOKEN, F.col("__tokens"), "random", len(KINDS))).otherwise(no_spans()))
    free = F.filter("__all", lambda s: is_mixed(s["match"]) & ~F.exists("base_spans", lambda b: overlaps(s, b)))
    df = df.withColumn("__free", F.when(F.col("__some"), free).otherwise(no_spans()))
    last = F.create_map(*(F.lit(x) for pair in steps.items() for x in pair)) if steps else F.lit(None).cast("map<string,int>")

    def counts(s: Column) -> Column:
        tested = lambda v: F.coalesce(v["ok"] & (step(v["score"]) <= last[token_class(s["match"])]), F.lit(False))
        return bound(battery(s["match"], encoding(s["match"])), tested)

    df = df.withColumn("spans", F.array_sort(F.concat("base_spans", F.when(F.size("__free") > 0, F.filter("__free", counts)).otherwise(no_spans()))))
    if not keep_text:
        return df.select(*kept, "base_spans", "spans")
    return df.select(*kept, "base_spans", "spans", F.when(F.size("spans") > 0, replaced(F.col(text), F.col("spans"), lambda kind: F.concat(F.lit("["), F.upper(kind), F.lit("]")))).otherwise(F.col(text)).alias("redacted"))


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns from ``base_spans`` and ``spans``."""
    return df.select("doc_id", *(counted(F.col("base_spans"), k.name).alias(f"n_{k.name}") for k in KINDS), F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
