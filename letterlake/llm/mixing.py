"""Mixing sources to target weights by Pareto order sampling.  DataFrame functions only.

Targets: sources share ``share`` times all words by weight; a source stops at ``most`` times its
own words, and what it leaves is shared again by weight (solved in closed form by water-filling
over the sources sorted by limit per weight).

Documents: within a source the expected copies of a document grow with its weight (by default a
mild preference for longer documents, by size class), again by water-filling so that they add up
to the target and none exceeds ``most``.  The whole part of the expected copies is certain.  The
rest is an inclusion probability p, and documents are ranked by the Pareto variable
(u / (1 - u)) / (p / (1 - p)) with u from a digest of the document; the first ones are taken until
their words reach what the target still lacks.

The rank order is cut by two levels of buckets whose words are summed before any shuffle, so that
only documents of the one small bucket in which the target is reached are ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from letterlake.llm.common import materialise, small, without

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words.
SHARE = 1.5
#: Copies that a document or source may have at most.
MOST = 2
#: Buckets of each of the two levels.
BUCKETS = 1024
SEED = "mix"
RESULT = ["size", "source_size", "target", "taken", "copies"]


def word_count(text: Column) -> Column:
    """Runs without blanks: starts of words, that is non-blanks after a blank or the beginning."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def filled(rows: DataFrame, keys: list[str], limit: str, weight: str, total: str, out: str) -> DataFrame:
    """Share ``total`` among the rows of each group of ``keys`` by ``weight``, none above its ``limit``.

    Sorted by limit per weight, the rows up to some place get their limits, and those beyond get
    the rest by weight.  ``limit`` and ``weight`` are whole numbers, ``total`` is constant in a group.
    """
    over = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    order = over.orderBy(F.col(limit) / F.col(weight), limit, weight)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    df = rows.withColumn("__w", F.sum(weight).over(over) - F.coalesce(F.sum(weight).over(before), F.lit(0)))
    df = df.withColumn("__level", (F.col(total) - F.coalesce(F.sum(limit).over(before), F.lit(0)).cast("double")) / F.col("__w"))
    # the first row whose limit is not below its share sets the level for itself and all after it
    df = df.withColumn("__level", F.min(F.when(F.col(limit).cast("double") >= F.col("__level") * F.col(weight), F.struct(F.col(limit) / F.col(weight), F.col("__level")))).over(over)["__level"])
    even = F.col("__level") * F.col(weight)
    return df.withColumn(out, F.when(F.col("__level").isNull() | (F.col(limit) < even), F.col(limit).cast("double")).otherwise(even)).drop("__w", "__level")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``; one row per source, sorted by code point, null last."""
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*(F.lit(w).cast("long") for w in weights))
    df = sizes.withColumn("__weight", F.get(cycle, place % len(weights)))
    df = df.withColumn("__limit", F.col("source_size") * most).withColumn("__total", F.sum("source_size").over(W.partitionBy(F.lit(0))) * F.lit(share))
    full = df.where("source_size > 0")
    return filled(full, [], "__limit", "__weight", "__total", "target").select("source", "source_size", "target").unionByName(df.where("source_size = 0").select("source", "source_size", F.lit(0.0).alias("target")))


def uniform(digest: Column) -> Column:
    """A number in (0, 1) from the first 12 hex digits of a digest."""
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def size_class(size: Column) -> Column:
    """Whole logarithm of the size to base 2; 0 for an empty text."""
    return (F.length(F.bin(size)) - 1).cast("long")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, keep_text: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies x size), all rows.

    A document is taken 0 to ``most`` whole times.  The same table gives the same mix: u is a
    digest of the document's id and text.  Rows with the same id and text have the same rank and
    are taken or left together.  A null source is a source of its own, after the others; null and
    empty texts have size 0 and are never taken; a null id is a value like others.  Input columns
    named like results are replaced.  An empty table gives an empty result.  ``keep_text=False``
    leaves the text out of the result and reads it once.
    """
    kept = without(docs, RESULT)
    key = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    added = [F.col(source).alias("__source"), word_count(F.col(text)).alias("size"), key.alias("__key")]
    if keep_text:
        base, narrow = docs.select(*kept, *added), materialise(docs.select(*added), "mix-sizes")
    else:
        kept = [c for c in kept if c != text]
        base = narrow = materialise(docs.select(*kept, *added), "mix-sizes")

    # words of each source and size class; targets of the sources; expected copies of the classes
    classes = materialise(narrow.groupBy(F.col("__source").alias("source"), size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("class_size")), "mix-classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")), weights, share, most)
    plan = classes.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumn("__limit", F.col("class_size") * most).withColumn("__weight", F.col("class_size") * (F.col("class") + 8))
    some = filled(plan.where("class_size > 0"), ["source"], "__limit", "__weight", "target", "__words")
    plan = some.withColumn("expected", F.col("__words") / F.col("class_size")).unionByName(plan.where("class_size = 0").select("*", F.lit(0.0).alias("__words"), F.lit(0.0).alias("expected")))
    plan = plan.withColumn("certain", F.floor("expected")).withColumn("p", F.col("expected") - F.col("certain"))
    own = W.partitionBy("source")
    open_words = F.sum(F.when(F.col("p") > 0, F.col("class_size")).otherwise(F.lit(0))).over(own).cast("double")
    lacking = F.least(F.col("target") - F.sum(F.col("class_size") * F.col("certain")).over(own), open_words)
    plan = small(materialise(plan.withColumn("lacking", lacking).select(F.col("source").alias("__s"), F.col("class").alias("__class"), "source_size", "target", "certain", "p", "lacking"), "mix-plan"))

    def ranked(df: DataFrame) -> DataFrame:
        """Pareto variable of the open documents (p > 0), and its place among buckets of equal width in q / (1 + q)."""
        df = df.join(plan, F.col("__source").eqNullSafe(F.col("__s")) & (size_class(F.col("size")) == F.col("__class")), "left").drop("__s", "__class")
        u = uniform(F.col("__key"))
        df = df.withColumn("__q", F.when((F.col("p") > 0) & (F.col("size") > 0), u / (1 - u) * (1 - F.col("p")) / F.col("p")))
        return df.withColumn("__bucket", F.least(F.floor(F.col("__q") / (1 + F.col("__q")) * (buckets * buckets)), F.lit(buckets * buckets - 1)))

    open_rows = ranked(narrow).where("__bucket IS NOT NULL AND lacking > 0")
    of_source = F.col("__source").eqNullSafe(F.col("__s"))
    wide = _reached(open_rows.groupBy("__source", F.floor(F.col("__bucket") / buckets).alias("b"), F.col("lacking").alias("goal")).agg(F.sum("size").alias("words")))
    wide = small(materialise(wide.withColumnRenamed("b", "__wide"), "mix-wide"))
    inner = open_rows.join(wide, of_source & (F.floor(F.col("__bucket") / buckets) == F.col("__wide"))).drop("__s")
    edge = _reached(inner.groupBy("__source", F.col("__bucket").alias("b"), F.col("__goal").alias("goal")).agg(F.sum("size").alias("words")))
    edge = small(materialise(edge.withColumnRenamed("b", "__edge"), "mix-edge"))
    # the documents of the bucket in which the goal is reached, in order: taken while at least half of the next one is lacking
    last = open_rows.join(edge, of_source & (F.col("__bucket") == F.col("__edge"))).groupBy("__source", "__key", "__q", "__goal", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("words"))
    order = W.partitionBy("__source").orderBy("__q", "__key", "size")
    upto = F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = last.withColumn("__in", F.col("__goal") - upto >= F.col("words") / 2).groupBy("__source").agg(F.max(F.when(F.col("__in"), F.struct("__q", "__key", "size"))).alias("__last"))
    cut = edge.join(last.withColumnRenamed("__source", "__t"), F.col("__s").eqNullSafe(F.col("__t")), "left").drop("__t", "__goal")
    cut = small(materialise(cut, "mix-cut"))

    whole = ranked(base).join(cut, of_source, "left")
    extra = (F.col("__bucket") < F.col("__edge")) | ((F.col("__bucket") == F.col("__edge")) & (F.struct("__q", "__key", "size") <= F.col("__last")))
    whole = whole.withColumn("copies", (F.coalesce("certain", F.lit(0)) + F.coalesce(extra, F.lit(False)).cast("long")).cast("long"))
    return whole.withColumn("taken", F.col("copies") * F.col("size")).select(*kept, *RESULT)


def _reached(sums: DataFrame) -> DataFrame:
    """Per source the first bucket with which the words reach the goal, and what lacks before it (``__goal``)."""
    order = W.partitionBy("__source").orderBy("b")
    upto = F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    df = sums.withColumn("__upto", upto).where("__upto < goal AND __upto + words >= goal")
    return df.select(F.col("__source").alias("__s"), "b", (F.col("goal") - F.col("__upto")).alias("__goal"))
