"""Quality rules with thresholds that adapt to each language and source.  DataFrame functions only.

Each document gets a few whole-number measures.  Per language and source a mergeable quantile
sketch of every measure is kept: counts of log-spaced buckets (16 per power of two, so a relative
error of at most 1/16), which merge by adding.  A measure's fences lie ``SPREAD`` scales beyond its
quartiles.  The scale is the interquartile range, but not less than the measure can resolve in that
group: what one event (a symbol, a repeated line, a repeated window) makes in a document of the
group's lower-quartile size.  So where a measure is zero for most documents, as symbols and repeats
are, the fence follows from the sizes of the group's documents, and no cutoff is fixed beforehand.

The fences of a group are drawn towards those of its language, and these towards the corpus's, with
the weight of ``MIN_DOCS`` documents: ``(n * own + MIN_DOCS * above) // (n + MIN_DOCS)``, so a group
of any size has thresholds of its own and small ones do not follow single documents.  Documents are
then joined with the fences of their group and judged.

The sketches have a bounded number of rows per group whatever the input; a hot source is
pre-aggregated map-side, so no task gets its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from letterlake.llm.common import materialise, small, without

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words of a window for repetition.
WINDOW = 8
#: Scales beyond the quartiles that a measure may lie.
SPREAD = 3
#: Documents that the fences of the level above weigh.
MIN_DOCS = 200
#: measure -> the size it is taken relative to, and units of the measure (per thousand) that one event makes: the
#: measures are per thousand words or lines, and word length in hundredths, which has no such unit.
MEASURES = {"symbol_rate": ("n_words", 1000), "dup_line_rate": ("n_lines", 1000), "repeat_rate": ("n_words", 2000 * WINDOW), "word_length": (None, 0)}
SIZES = ["n_words", "n_lines"]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULT = [*BASE, "n_lines", *MEASURES]


def trimmed_words(text: Column) -> Column:
    """The words (runs without blanks) of ``text``; null has none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACES, -1))


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the ``BASE`` columns, ``n_lines`` and the measures of ``MEASURES``, all long."""
    t = F.coalesce(F.col(text), F.lit(""))
    kept = without(docs, RESULT)
    # each step is a projection of its own, so that no array is computed twice
    df = docs.select(*kept, trimmed_words(F.col(text)).alias("__w"), F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("__lines"))
    df = df.select(
        *kept,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__w", lambda x: F.xxhash64(x)).alias("__h"),
    )
    # hashes of 2, 4 and then 8 consecutive words, each from two of the step before
    for step in (1, 2, 4):
        more = F.greatest(F.size("__h") - step, F.lit(0))
        df = df.withColumn("__h", F.zip_with(F.slice("__h", F.lit(1), more), F.slice("__h", F.lit(step + 1), more), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.array_sort(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = F.filter("__s", lambda p, k: F.coalesce(F.get("__s", k - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get("__s", k + 1)["h"] == p["h"], F.lit(False)))
    df = df.withColumn("__at", F.array_sort(F.transform(twice, lambda p: p["i"])))
    gaps = F.zip_with("__at", F.slice("__at", F.lit(2), F.greatest(F.size("__at") - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    df = df.withColumn("n_repeat_words", F.when(F.col("__at").isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda a, x: a + x)).cast("long"))
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return df.select(
        *kept,
        *BASE,
        "n_lines",
        F.expr("1000 * n_symbols").__truediv__(words).cast("long").alias("symbol_rate"),
        F.expr("1000 * n_dup_lines").__truediv__(lines).cast("long").alias("dup_line_rate"),
        F.expr("1000 * n_repeat_words").__truediv__(words).cast("long").alias("repeat_rate"),
        F.expr("100 * word_chars").__truediv__(words).cast("long").alias("word_length"),
    )


def bucket(x: Column) -> Column:
    """The sketch bucket of a whole number >= 0: itself below 16, then 16 buckets per power of two."""
    e = F.length(F.bin(x)) - 5
    return F.when(x < 16, x).otherwise(e * 16 + F.floor(x / F.pow(F.lit(2.0), e)).cast("long"))


def bucket_low(b: Column) -> Column:
    """The smallest number of a bucket."""
    e = F.floor(b / 16) - 1
    return F.when(b < 16, b).otherwise(((F.lit(16) + b % 16) * F.pow(F.lit(2.0), e)).cast("long"))


def bucket_high(b: Column) -> Column:
    """The largest number of a bucket."""
    return bucket_low(b + 1) - 1


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Bucket counts: lang, source, measure, bucket, n."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in [*MEASURES, *SIZES])))
    rows = measured.select(F.col(lang).alias("lang"), F.col(source).alias("source"), each.alias("x"))
    return rows.groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, min_docs: int = MIN_DOCS, spread: int = SPREAD) -> DataFrame:
    """``max_`` and ``min_`` of each measure, the highest and lowest allowed values, by lang and source: one row per group."""
    sketch, levels = sketch.withColumn("__one", F.lit(1)), []
    # the key __one makes the whole corpus a group like others
    for k, keys in ((2, ["lang", "source"]), (1, ["lang"]), (0, ["__one"])):
        merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        over = W.partitionBy(*keys, "measure")
        ranked = merged.withColumn("upto", F.sum("n").over(over.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(over))
        quartiles = ranked.groupBy(*keys, "measure").agg(
            F.first("all").alias("docs"),
            F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("bucket"))).alias("q1"),
            F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3, F.col("bucket"))).alias("q3"),
        )
        of = lambda m, value: F.max(F.when(F.col("measure") == m, value))
        each = [of(m, bucket_low(F.col("q1"))).alias(f"low_{m}") for m in [*MEASURES, *SIZES]] + [of(m, bucket_high(F.col("q3"))).alias(f"high_{m}") for m in MEASURES]
        wide = quartiles.groupBy(*keys).agg(F.max("docs").alias(f"docs{k}"), *each)
        out = []
        for m, (size, event) in MEASURES.items():
            one = F.expr(f"{event} div greatest(low_{size}, 1)") if size else F.lit(0)
            scale = F.greatest(F.col(f"high_{m}") - F.col(f"low_{m}"), one)
            out += [(F.col(f"high_{m}") + spread * scale).alias(f"max_{m}{k}"), F.greatest(F.col(f"low_{m}") - spread * scale, F.lit(0)).alias(f"min_{m}{k}")]
        levels.append(wide.select(*keys, f"docs{k}", *out))
    both, by_lang, whole = levels
    joined = both.alias("a").join(by_lang.alias("b"), F.expr("a.lang <=> b.lang")).select("a.*", *(F.col(f"b.{c}") for c in by_lang.columns[1:]))
    joined = joined.withColumn("__one", F.lit(1)).join(whole, "__one")
    names = [f"{side}_{m}" for m in MEASURES for side in ("max", "min")]
    for k in (1, 2):
        joined = joined.select("*", *(F.expr(f"({c}{k} * docs{k} + {c}{'0' if k == 1 else '_1'} * {min_docs}) div (docs{k} + {min_docs})").alias(f"{c}_{k}") for c in names))
    return joined.select("lang", "source", *(F.col(f"{c}_2").alias(c) for c in names))


def judged(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` plus ``base_failed`` and ``kept``; joined with the limits of its group, null keys included."""
    names = [f"{side}_{m}" for m in MEASURES for side in ("max", "min")]
    limits = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *(F.col(c).alias(f"__{c}") for c in names))
    df = measured.join(small(limits), F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source")), "left")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    beyond = F.lit(False)
    for m in MEASURES:
        beyond = beyond | (F.col(m) > F.col(f"__max_{m}")) | (F.col(m) < F.col(f"__min_{m}"))
    # one expression that a filter on it cannot take apart: part of it below the join would repeat the measuring
    kept = F.when(failed, False).when(beyond, False).otherwise(True)
    return df.withColumn("base_failed", failed).withColumn("kept", kept).drop("__lang", "__source", *(f"__{c}" for c in names))


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, keep_text: bool = True) -> DataFrame:
    """``docs`` with its measures (``BASE``, ``n_lines`` and ``MEASURES`` columns), ``base_failed`` and ``kept``.

    Every text is measured once, whole, through a table of measures (``keep_text=False`` leaves the
    text out of it and of the result).  A null or empty text has no words and fails the base rules.
    Null languages and sources are groups of their own.  Values on a fence are kept; every row,
    repeated ones too, gets its own result, and equal rows the same one.  Input columns named like
    results are replaced, others stay; an empty table gives an empty result.
    """
    docs = docs.select(*without(docs, ["base_failed", "kept"]))
    measured = with_measures(docs, text)
    measured = materialise(measured if keep_text else measured.drop(text), "quality-measures")
    limits = materialise(fences(sketches(measured, lang, source), min_docs), "quality-fences")
    return judged(measured, limits, lang, source)
