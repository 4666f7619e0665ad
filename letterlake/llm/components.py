"""Connected components with joins and aggregations, for edges of any number.

Alternates the two star operations known from large-scale component search: every node is linked to
the smallest node among itself and its neighbours, first for the larger and then for the smaller
neighbours, until nothing changes.  Smallest neighbours are found by a partially aggregated
minimum, so a hub's neighbours are never gathered, and the joins broadcast the minima within a
bound or deal a hub's edges out over partitions.  The tables of earlier rounds are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterlake.llm.common import BROADCAST_ROWS, discard, is_small, materialise, spread_join

#: Rounds after which something must be wrong: each shortens paths by a constant factor.
MOST_ROUNDS = 60
#: Rows of a task where edges are few (``BROADCAST_ROWS`` at most).
TASK_ROWS = 20_000
#: Blocks into which a group is cut at least, so that its comparisons spread over tasks.
LEAST_BLOCKS = 32


def _gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, made of ``rows`` edges: few edges in few tasks, whatever the number of shuffle partitions."""
    return df.coalesce(-(-max(rows, 1) // TASK_ROWS)) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of ``edges``
    (``u``, ``v``, any one orderable type; loops and repeated edges are fine)."""
    df = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    df, before = materialise(df, "components"), None
    rows = df.count()
    for _ in range(MOST_ROUNDS):
        last = df
        both = df.union(df.select("v", "u"))
        low = _gathered(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), rows)
        # larger neighbours move to the smallest node around
        df = spread_join(both.where("v > u"), low, ["u"], "n", 2 * rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        df = _gathered(df, rows)
        low = _gathered(df.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), rows)
        # smaller neighbours and the node itself move to the smallest one
        down = spread_join(df, low, ["u"], "n", 2 * rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        df = materialise(_gathered(down.union(low.select("u", F.col("m").alias("v"))).distinct(), rows), "components")
        state = tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(last)
        if state == before:
            roots = df.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, rows = state, state[0]
    raise RuntimeError("components did not settle")


def stars(members: DataFrame) -> DataFrame:
    """Edges ``u``, ``v`` from each ``item`` to the smallest item of each ``bucket`` it is in; buckets of one item give none.

    Only smallest and largest items of the buckets are shuffled; few buckets have two items, so
    the members mostly meet them in a broadcast.  Beyond its bound the join shuffles, and heavy
    buckets are dealt out.
    """
    hubs = members.groupBy("bucket").agg(F.min("item").alias("v"), F.max("item").alias("far"), F.count(F.lit(1)).alias("n")).where("v <> far").drop("far")
    return starred(members, materialise(hubs, "components-hubs"))


def starred(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """Edges from each ``item`` to the item ``v`` that ``hubs`` (``bucket``, ``v``, ``n`` members) has for its bucket."""
    if is_small(hubs):
        met = members.join(F.broadcast(hubs), "bucket")
    else:
        met = spread_join(members, hubs, ["bucket"], "n", hubs.agg(F.sum("n")).first()[0])
    return met.where("item <> v").select(F.col("item").alias("u"), "v").distinct()


def with_group(members: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``members`` inner-joined with ``table`` on ``key``, groups of any size."""
    if is_small(table):
        return members.join(F.broadcast(table), key)
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return spread_join(members, table.join(sizes, key), [key], "__n", members.count(), wide=True)


def in_blocks(members: DataFrame, rows: int, size: int) -> DataFrame:
    """``members`` (``root``, ``item``, ``bytes``, ...) dealt out for comparing all pairs of each component.

    A component of more than half of ``rows`` members or of ``size`` bytes is cut into blocks by a
    hash of the item, and every pair of blocks is a group ``root``, ``i``, ``j`` of its own
    (``block`` tells them apart); so no group exceeds a few times these bounds, whatever the
    component's size, and a large component is at least ``LEAST_BLOCKS`` wide.
    """
    n = F.col("__n")
    per = F.least(F.lit(rows), F.greatest(F.lit(max(rows // 8, 1)), F.ceil(n / LEAST_BLOCKS)))
    total = members.groupBy("root").agg(F.count(F.lit(1)).alias("__n"), F.sum("bytes").alias("__bytes"))
    blocks = F.greatest(F.when(n * 2 <= rows, F.lit(1)).otherwise(F.ceil(n / per)), F.ceil(F.col("__bytes") / size), F.lit(1)).cast("int")
    df = spread_join(members, total.select("root", blocks.alias("__blocks"), "__n"), ["root"], "__n", members.count())
    df = df.withColumn("block", F.pmod(F.xxhash64("item"), F.col("__blocks")).cast("int"))
    df = df.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    df = df.withColumn("i", F.least("block", "__other")).withColumn("j", F.greatest("block", "__other"))
    return df.drop("__other", "__blocks")
