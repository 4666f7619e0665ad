"""Which mailbox a folder belongs to, where an old archive kept the two apart.

Witnesses come first: snapshots name both, and a message of one mailbox places all its folders.
Elimination then pairs the one unexplained mailbox of a message with its one unplaced folder, in
passes over the messages in ascending order of id, until a pass learns nothing.  What a message
teaches counts for the next one of the same pass, and a new owner can make a folder ambiguous
again, so the order matters; the result here is that of the sequential rule exactly, however many
tasks there are.

Only messages with an unplaced folder can ever teach anything, and they touch each other only
through folders that are unplaced in one of them.  So the messages fall into independent
components.  Those of at most ``per_task`` messages are settled whole, many at a time.  Larger ones
are cut into blocks of consecutive ids.  Until a message can teach something nothing changes, and
which ones can is seen in all blocks at once; so of each large component the block with the next
such message is run, from that message on, and then the next one is looked for.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Messages that one task settles.
MESSAGES = 50_000
#: Rounds of a component search after which something must be wrong: each follows labels twice as far.
MOST_ROUNDS = 60


def witnesses(mailbox: DataFrame, folder: DataFrame, snapshot: DataFrame) -> DataFrame:
    """folder and mailbox pairs that snapshots or single-mailbox messages vouch for."""
    single = mailbox.distinct().groupBy("message_id").agg(F.count(F.lit(1)).alias("n"), F.min("mailbox").alias("mailbox")).where("n = 1")
    return snapshot.select("folder", "mailbox").union(folder.join(single, "message_id").select("folder", "mailbox")).distinct()


def _settled(messages: pd.DataFrame, known: pd.DataFrame, once: bool) -> pd.DataFrame:
    """What passes (or one pass) over some messages (message_id, mailboxes, folders) teach, in order of id, against ``known`` owners."""
    owners: dict[str, set[str]] = {}
    for folder, mailbox in zip(known["folder"], known["mailbox"]):
        owners.setdefault(folder, set()).add(mailbox)
    rows = [(set(m.mailboxes), list(m.folders)) for m in messages.sort_values("message_id").itertuples()]
    learnt: list[tuple[str, str]] = []
    going = True
    while going:
        going, rest = False, []
        for boxes, folders in rows:
            fits = {f: owners.get(f, set()) & boxes for f in folders}
            unplaced = [f for f, own in fits.items() if not own]
            unexplained = boxes.difference(*(own for own in fits.values() if len(own) == 1))
            if len(unplaced) == 1 and len(unexplained) == 1:
                owners.setdefault(unplaced[0], set()).update(unexplained)
                learnt.append((unplaced[0], *unexplained))
                going = not once
            elif unplaced:
                # a message whose folders all have owners can teach nothing any more
                rest.append((boxes, folders))
        rows = rest
    return pd.DataFrame(learnt, columns=["folder", "mailbox"])


def _facts(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """``unplaced`` (number of folders) and ``ready`` (it can teach something) of each message of ``pairs``."""
    met = pairs.join(seen.withColumn("known", F.lit(1)), ["folder", "mailbox"], "left")
    each = met.groupBy("message_id", "boxes", "folder").agg(F.count("known").alias("n"), F.min(F.when(F.col("known") == 1, F.col("mailbox"))).alias("own"))
    # the mailboxes of one message are its own few
    all_ = each.groupBy("message_id", "boxes").agg(F.count_if(F.col("n") == 0).alias("unplaced"), F.size(F.collect_set(F.when(F.col("n") == 1, F.col("own")))).alias("explained"))
    return all_.select("message_id", "unplaced", ((F.col("unplaced") == 1) & (F.col("boxes") - F.col("explained") == 1)).alias("ready"))


def _labels(edges: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for ``edges`` (u, v; loops for nodes alone)."""
    both = cut(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    roots = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")))
    for _ in range(MOST_ROUNDS):
        near = both.join(roots.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        low = cut(roots.join(near, "node").select("node", "root", F.least("root", "near").alias("low")))
        # a root that sees a smaller one takes its whole tree along
        hooked = low.groupBy("root").agg(F.min("low").alias("to"))
        jump = cut(low.join(hooked, "root").select("node", "root", F.least("low", "to").alias("to")))
        after = jump.alias("a").join(jump.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", "root", "further")
        after = cut(after)
        if after.where("root <> further").isEmpty():
            return roots
        roots = after.select("node", F.col("further").alias("root"))
    raise RuntimeError("components did not settle")


def _blocks(messages: DataFrame, per_task: int, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``messages`` (component, message_id, ...) with ``block``: at most ``per_task`` consecutive ones of a component, in order."""
    ordered = messages.repartitionByRange("component", "message_id").withColumn("slice", F.spark_partition_id())
    ordered = cut(ordered)
    # slices are of even size whatever the component's
    nth = F.row_number().over(W.partitionBy("slice").orderBy("component", "message_id")) - 1
    return cut(ordered.withColumn("block", F.struct("slice", F.floor(nth / per_task).alias("nth"))).drop("slice"))


def _run(messages: DataFrame, pairs: DataFrame, seen: DataFrame, group: list[str], once: bool) -> DataFrame:
    """What groups of ``messages`` teach, each in one task."""
    known = messages.select("message_id", *group).join(pairs, "message_id").join(seen, ["folder", "mailbox"]).select(*group, "folder", "mailbox").distinct()
    known = known.select(*(F.col(g).alias(f"of_{g}") for g in group), "folder", "mailbox")
    grouped = messages.select(*group, "message_id", "mailboxes", "folders").groupBy(*group)
    return grouped.cogroup(known.groupBy(*(f"of_{g}" for g in group))).applyInPandas(lambda m, k: _settled(m, k, once), "folder string, mailbox string")


def owners(mailbox: DataFrame, folder: DataFrame, snapshot: DataFrame, cut: Callable[[DataFrame], DataFrame], per_task: int = MESSAGES) -> DataFrame:
    """folder and mailbox: every mailbox that each folder can belong to."""
    seen = cut(witnesses(mailbox, folder, snapshot))
    boxes = mailbox.where("mailbox IS NOT NULL").distinct()
    several = boxes.groupBy("message_id").agg(F.count(F.lit(1)).alias("boxes")).where("boxes > 1")
    pairs = cut(folder.where("folder IS NOT NULL").distinct().join(several, "message_id").join(boxes, "message_id"))
    live = _facts(pairs, seen).where("unplaced > 0").select("message_id")
    pairs = cut(pairs.join(live, "message_id", "left_semi"))
    messages = cut(pairs.groupBy("message_id").agg(F.collect_set("mailbox").alias("mailboxes"), F.collect_set("folder").alias("folders")))
    total = messages.count()
    if total <= per_task:
        return cut(seen.unionByName(_run(messages.withColumn("task", F.lit(0)), pairs, seen, ["task"], once=False)).distinct())
    placed = pairs.join(seen, ["folder", "mailbox"], "left_semi").select("message_id", "folder").distinct()
    at = pairs.select("message_id", "folder").distinct()
    unplaced = at.join(placed, ["message_id", "folder"], "left_anti").select("folder").distinct()
    at = cut(at.join(unplaced, "folder", "left_semi"))
    hubs = at.groupBy("message_id").agg(F.min("folder").alias("u"))
    roots = _labels(at.join(hubs, "message_id").select("u", F.col("folder").alias("v")).distinct(), cut)
    component = hubs.join(roots.withColumnRenamed("node", "u"), "u").select("message_id", F.col("root").alias("component"))
    messages = cut(messages.join(component, "message_id"))
    sizes = cut(messages.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    tasks = -(-total // per_task)
    small = messages.join(sizes.where(F.col("n") <= per_task), "component", "left_semi").withColumn("task", F.pmod(F.xxhash64("component"), F.lit(tasks)))
    seen = cut(seen.unionByName(_run(small, pairs, seen, ["task"], once=False)).distinct())
    large = messages.join(sizes.where(F.col("n") > per_task), "component", "left_semi")
    if large.isEmpty():
        return seen
    large = _blocks(large, per_task, cut)
    last = large.groupBy("component", "block").agg(F.max("message_id").alias("last"))
    last = cut(last)
    own = cut(pairs.join(large.select("message_id"), "message_id", "left_semi"))
    # how far the pass over each component has come
    at = large.select("component").distinct().withColumn("upto", F.lit(None).cast(large.schema["message_id"].dataType))
    while True:
        ready = _facts(own, seen).where("ready").join(large, "message_id").join(at, "component")
        # the next one of this pass, else the first one of the next pass
        passed = F.coalesce(F.col("message_id") <= F.col("upto"), F.lit(False))
        turn = cut(ready.groupBy("component").agg(F.min(F.struct(passed.alias("passed"), "message_id", "block")).alias("next")).select("component", F.col("next.message_id").alias("begin"), "next.block"))
        if turn.isEmpty():
            return seen
        now = large.join(turn, ["component", "block"]).where(F.col("message_id") >= F.col("begin"))
        seen = cut(seen.unionByName(_run(now, own, seen, ["component"], once=True)).distinct())
        moved = turn.join(last, ["component", "block"]).select("component", "last")
        at = cut(at.join(moved, "component", "left").select("component", F.coalesce("last", "upto").alias("upto")))


def attributed(message: DataFrame, mailbox: DataFrame, folder: DataFrame, owner: DataFrame) -> DataFrame:
    """store_id, mailbox and folder of every message; a mailbox with no folder of its own has a null folder."""
    boxes = mailbox.select("message_id", "mailbox").distinct()
    fits = folder.distinct().join(owner, "folder").join(boxes, ["message_id", "mailbox"])
    sure = fits.groupBy("message_id", "folder").agg(F.count(F.lit(1)).alias("n"), F.min("mailbox").alias("mailbox")).where("n = 1").drop("n")
    return boxes.join(sure, ["message_id", "mailbox"], "left").join(message, "message_id").select("store_id", "mailbox", "folder")


def attribution_counts(message: DataFrame, mailbox: DataFrame, folder: DataFrame, owner: DataFrame) -> DataFrame:
    """messages, placeless (messages without mailbox, and mailboxes without folder) and undecidable (folders): one row."""
    boxes = mailbox.select("message_id", "mailbox").distinct()
    placed = attributed(message, mailbox, folder, owner)
    bare = message.join(boxes, "message_id", "left_anti").agg(F.count(F.lit(1)).alias("bare"))
    all_folders = folder.distinct().join(boxes.select("message_id").distinct(), "message_id", "left_semi").join(message, "message_id", "left_semi").agg(F.count(F.lit(1)).alias("all"))
    sums = placed.agg(F.count_if(F.col("folder").isNull()).alias("no_folder"), F.count("folder").alias("decided"))
    k = F.lit(1).alias("k")
    out = message.agg(F.count(F.lit(1)).alias("messages")).select("*", k)
    for part in (bare, all_folders, sums):
        out = out.join(part.select("*", k), "k")
    return out.select("messages", (F.col("bare") + F.col("no_folder")).alias("placeless"), (F.col("all") - F.col("decided")).alias("undecidable"))
