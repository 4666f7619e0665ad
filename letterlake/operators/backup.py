"""What a backup fetches: a server's listing against resume points and the archive.

A head's resume point names the folder's validity and the highest uid that has been recorded.  A
server that has renumbered the folder gives another validity, and the point is void: what the
archive lacks is then told from the listing, as in a reconciliation.  Places compare null-safely.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterlake import schema
from letterlake.operators import reconcile

FIRST, ABOVE, BELOW, LOST = "FIRST", "ABOVE", "BELOW", "LOST"
_POINT = schema.of("kind string, uidvalidity long, uid long")


def _same_place(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """``left`` joined by place with ``right``, whose mailbox and folder go."""
    r = right.withColumnsRenamed({"mailbox": "__m", "folder": "__f"})
    out = left.join(r, F.col("mailbox").eqNullSafe(F.col("__m")) & F.col("folder").eqNullSafe(F.col("__f")), how)
    return out.drop("__m", "__f")


def points(heads: DataFrame) -> DataFrame:
    """folder, uidvalidity and uid of the heads with a resume point that names both."""
    point = F.from_json("resume", _POINT)
    usable = (point["kind"] == "imap-uid") & point["uid"].isNotNull() & point["uidvalidity"].isNotNull()
    return heads.where(usable & F.col("folder").isNotNull()).select("folder", point["uidvalidity"].alias("uidvalidity"), point["uid"].alias("uid"))


def scanned(listing: DataFrame, heads: DataFrame) -> DataFrame:
    """``listing`` (mailbox, folder, validity, ord, mid, ...) with ``scan``.

    FIRST: nothing was recorded at the place.  ABOVE and BELOW: against the uid of a resume point of
    the same validity.  LOST: there is a log, but no point that the server honours.
    """
    point = F.from_json("resume", _POINT)
    usable = (point["kind"] == "imap-uid") & point["uid"].isNotNull()
    known = heads.select("mailbox", "folder", F.when(usable, point["uidvalidity"]).alias("__validity"), F.when(usable, point["uid"]).alias("__uid"), F.col("log").isNotNull().alias("__log"))
    both = _same_place(listing, known, "left")
    honoured = F.coalesce(F.col("__validity") == F.col("validity"), F.lit(False))
    scan = F.when(honoured & (F.col("ord") > F.col("__uid")), ABOVE).when(honoured, BELOW).when(F.coalesce("__log", F.lit(False)), LOST).otherwise(FIRST)
    return both.withColumn("scan", scan).drop("__validity", "__uid", "__log")


def wanted(scan: DataFrame, archived: DataFrame) -> DataFrame:
    """The rows of ``scanned`` to fetch: first and new ones, and of lost places those without an archived copy (``archived`` as in ``reconcile.claims``)."""
    lost = reconcile.claims(scan.where(F.col("scan") == LOST), archived)
    missing = lost.where(F.col("claim") != reconcile.TAKEN).drop("claim")
    return scan.where(F.col("scan").isin(FIRST, ABOVE)).unionByName(missing)


def advanced(listing: DataFrame, outcome: DataFrame) -> DataFrame:
    """mailbox, folder and resume (JSON text) of the listed places where no fetch failed.

    ``outcome`` has mailbox, folder and store_id (null where the fetch failed).  The other places
    keep their points, so that the next backup asks for the same messages again.
    """
    top = listing.groupBy("mailbox", "folder").agg(F.max("validity").alias("uidvalidity"), F.max("ord").alias("uid"))
    failed = outcome.where("store_id IS NULL").select("mailbox", "folder").distinct()
    point = F.to_json(F.struct(F.lit("imap-uid").alias("kind"), "uidvalidity", "uid"))
    return _same_place(top, failed, "left_anti").select("mailbox", "folder", point.alias("resume"))
