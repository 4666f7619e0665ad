"""Column expressions for names, dates and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def contains_ci(text: Column, query: str) -> Column:
    """Substring test that ignores the case of A-Z only and has no wildcards."""
    return F.contains(ascii_fold(text), F.lit(query.translate(str.maketrans(UPPER, LOWER))))


def place_label(mailbox: Column, folder: Column) -> Column:
    """``mailbox::folder``, or the half that is known; ``?`` if neither is."""
    return F.when(mailbox.isNull() & folder.isNull(), F.lit("?")).otherwise(F.concat_ws("::", mailbox, folder))


def day_of(date: Column) -> Column:
    """The day of an ISO date text, as its sender wrote it."""
    return F.substring(date, 1, 10)


def entry_hash(name: Column) -> Column:
    """The lower-cased hash that a stored message's file name carries, else null."""
    return F.lower(F.nullif(F.regexp_extract(name, r"^([0-9a-fA-F]+)\.eml(\.zst)?\z", 1), F.lit("")))


def is_hash(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[0-9a-fA-F]+\z"), F.lit(False))


def usable_resume(resume: Column) -> Column:
    """A resume point counts only as a JSON object with a non-empty text ``kind``."""
    kind = F.get_json_object(resume, "$.kind")
    return F.coalesce((F.length(kind) > 0) & resume.rlike(r'"kind"\s*:\s*"'), F.lit(False))


def human_size(size: Column) -> Column:
    """Bytes in steps of 1024, one decimal."""
    out = F.concat(F.round(size / 1024**4, 1).cast("string"), F.lit(" TiB"))
    for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
        out = F.when(size < 1024 ** (power + 1), F.concat(F.format_number(size / 1024**power, 1), F.lit(f" {unit}"))).otherwise(out)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(out)


def graph_timestamp(value: Column) -> Column:
    """A timestamp that names its zone; null without one or if it cannot be read."""
    return F.when(value.rlike(r"([zZ]|[+-]\d{2}:?\d{2})\z"), F.try_to_timestamp(value))
