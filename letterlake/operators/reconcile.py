"""Server listings against the archive, as multisets of Message-IDs per place."""

from __future__ import annotations

import bisect
import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Ids up to this length never match by prefix; servers cut longer ones.
LONG = 128
TAKEN, EXHAUSTED, ABSENT = "TAKEN", "EXHAUSTED", "ABSENT"
_PLACE = ["mailbox", "folder"]


def archived_counts(observation: DataFrame, message: DataFrame) -> DataFrame:
    """mailbox, folder, mid and n: distinct messages with each usable Message-ID at each known place.

    ``message`` has store_id and mid (normalised).  Places without a mailbox are left out.
    """
    seen = observation.where("mailbox IS NOT NULL").select(*_PLACE, "store_id").distinct()
    return seen.join(message.where("mid <> ''").select("store_id", "mid"), "store_id").groupBy(*_PLACE, "mid").agg(F.count(F.lit(1)).alias("n"))


def claims(listing: DataFrame, archived: DataFrame) -> DataFrame:
    """``listing`` (mailbox, folder, ord, mid, ...) with ``claim``.

    In listing order each id takes one archived copy: TAKEN while there are any, EXHAUSTED after
    that, ABSENT if there never was one or the id is empty.  A long id without an exact match takes
    the copies of archived ids that it begins, so ids of one place that share their first ``LONG``
    characters with it are settled together, in order; a prefix match cannot cross those.  All
    others are ranked against their count in one window, and empty ids need none.
    """
    names = [*listing.columns, "claim"]
    usable = F.coalesce(F.col("mid") != "", F.lit(False))
    absent = listing.where(~usable).withColumn("claim", F.lit(ABSENT))
    stem = F.when(F.length("mid") > LONG, F.substring("mid", 1, LONG))
    exact = _null_safe(listing.where(usable), archived).withColumn("__stem", stem)
    hard = exact.where(F.col("__stem").isNotNull() & F.col("n").isNull()).select(*_PLACE, F.col("__stem").alias("__key")).distinct()
    marked = _with_stem(exact, hard)
    # ids without a copy are absent whatever their order, so they are not ranked and never meet
    ranked = F.row_number().over(W.partitionBy(*_PLACE, "mid").orderBy("ord"))
    there = marked.where("__hard IS NULL AND n IS NOT NULL").withColumn("claim", F.when(ranked <= F.col("n"), TAKEN).otherwise(EXHAUSTED))
    without = marked.where("__hard IS NULL AND n IS NULL").withColumn("claim", F.lit(ABSENT))
    rest = marked.where("__hard IS NOT NULL").select(*listing.columns, "__stem")
    schema = rest.select(*listing.columns, F.lit("").alias("claim")).schema
    keys = [*_PLACE, "__stem"]
    own = _with_stem(archived.select(*_PLACE, "mid", "n").withColumn("__stem", stem), hard).where("__hard IS NOT NULL").drop("__hard")
    slow = rest.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInPandas(_sequential, schema)
    out = absent.select(*names)
    for part in (there, without, slow):
        out = out.unionByName(part.select(*names))
    return out


def _null_safe(listing: DataFrame, archived: DataFrame) -> DataFrame:
    a = archived.select(F.col("mailbox").alias("__m"), F.col("folder").alias("__f"), F.col("mid").alias("__mid"), "n")
    same = F.col("mailbox").eqNullSafe(F.col("__m")) & F.col("folder").eqNullSafe(F.col("__f")) & (F.col("mid") == F.col("__mid"))
    return listing.join(a, same, "left").drop("__m", "__f", "__mid")


def _with_stem(df: DataFrame, hard: DataFrame) -> DataFrame:
    """``df`` with ``__hard`` set where its place and ``__stem`` are among ``hard``."""
    p = hard.select(F.col("mailbox").alias("__m"), F.col("folder").alias("__f"), "__key", F.lit(True).alias("__hard"))
    same = F.col("mailbox").eqNullSafe(F.col("__m")) & F.col("folder").eqNullSafe(F.col("__f")) & (F.col("__stem") == F.col("__key"))
    return df.join(p, same, "left").drop("__m", "__f", "__key")


def _sequential(listing: pd.DataFrame, archived: pd.DataFrame) -> pd.DataFrame:
    left = dict(zip(archived["mid"], archived["n"]))
    long_ids = sorted(left)
    out = []
    listing = listing.sort_values("ord", kind="stable").drop(columns="__stem")
    for mid in listing["mid"]:
        if mid in left:
            names = [mid]
        else:
            # the ids that begin with mid stand together
            at = bisect.bisect_left(long_ids, mid)
            names = list(itertools.takewhile(lambda m: m.startswith(mid), itertools.islice(long_ids, at, None)))
        with_copies = next((m for m in names if left[m] > 0), None)
        if with_copies is not None:
            left[with_copies] -= 1
        out.append(TAKEN if with_copies is not None else EXHAUSTED if names else ABSENT)
    return listing.assign(claim=out)


def verdicts(claimed: DataFrame) -> DataFrame:
    """listed, missing (ABSENT) and extra_copies (EXHAUSTED) of each place."""
    return claimed.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("listed"), F.count_if(F.col("claim") == ABSENT).alias("missing"), F.count_if(F.col("claim") == EXHAUSTED).alias("extra_copies"))


def repairs(claimed: DataFrame, fetched: DataFrame, store: DataFrame) -> DataFrame:
    """restored, recovered, known and failed per place, for wanted messages (not TAKEN) whose content was fetched.

    ``fetched`` has mailbox, folder, ord and store_id (null where the fetch failed).
    """
    wanted = claimed.where(F.col("claim") != TAKEN)
    f = fetched.select(F.col("mailbox").alias("__m"), F.col("folder").alias("__f"), F.col("ord").alias("__o"), F.col("store_id"))
    same = F.col("mailbox").eqNullSafe(F.col("__m")) & F.col("folder").eqNullSafe(F.col("__f")) & (F.col("ord") == F.col("__o"))
    got = wanted.join(f, same, "left").join(store.select("store_id", F.lit(True).alias("there")).distinct(), "store_id", "left")
    kind = F.when(F.col("store_id").isNull(), "failed").when(F.col("claim") == ABSENT, "restored").when(F.col("there").isNull(), "recovered").otherwise("known")
    kinds = got.withColumn("kind", kind).groupBy(*_PLACE)
    return kinds.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("restored", "recovered", "known", "failed")))


def guard(jobs: DataFrame, heads: DataFrame, observation: DataFrame) -> DataFrame:
    """Jobs whose name the archive does not know: from the heads, or the log where there are no heads."""
    names = heads.where("mailbox IS NOT NULL").select("mailbox").union(observation.where("mailbox IS NOT NULL").select("mailbox").join(heads.limit(1).select(F.lit(1).alias("k")), F.lit(True), "left_anti"))
    return jobs.join(names.distinct(), jobs["name"] == names["mailbox"], "left_anti")
