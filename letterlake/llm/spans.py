"""Places of pattern matches in texts, with DataFrame functions only.

Spark returns what a pattern matches but not where.  A text split at the matches gives the pieces
between them; running sums of the lengths of pieces and matches give the places.  The sums run in
slices of ``SLICE`` matches, because a list that grows by one is copied each time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches of a text whose places are gathered in one list before they join the others.
SLICE = 256
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,match:string>>"


@dataclass(frozen=True)
class Kind:
    """A kind of span: matches of ``pattern`` that pass ``holds``; ``hint`` is a cheap test that every text with a match passes."""

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    holds: Callable[[Column], Column]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def no_spans() -> Column:
    return F.array().cast(SPAN)


def placed(text: Column, pattern: Column | str, matches: Column, kind: str, rank: int) -> Column:
    """Spans of all ``matches`` of ``pattern`` (leftmost, non-overlapping) in ``text``; code points, end exclusive."""
    pieces = F.split(text, F.lit(pattern) if isinstance(pattern, str) else pattern, -1)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match"))
        return F.when(x["match"].isNull(), state).otherwise(F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out")))

    def in_slice(state: Column, part: Column) -> Column:
        begin = F.struct(state["at"].alias("at"), no_spans().alias("out"))
        own = F.aggregate(part, begin, step)
        return bound(own, lambda v: F.struct(v["at"].alias("at"), F.concat(state["out"], v["out"]).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))
    pairs = F.arrays_zip(pieces.alias("piece"), matches.alias("match"))
    slices = bound(pairs, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / SLICE).cast("int")), lambda k: F.slice(x, k * SLICE + 1, F.lit(SLICE))))
    return F.when(F.size(matches) > 0, F.aggregate(slices, begin, in_slice, lambda s: s["out"])).otherwise(no_spans())


def _holding(kind: Kind) -> Callable[[Column], Column]:
    return lambda s: F.coalesce(kind.holds(s["match"]), F.lit(False))


def with_spans(df: DataFrame, text: str, kinds: tuple[Kind, ...], out: str = "__spans") -> DataFrame:
    """``df`` with ``out``: the spans of all kinds, by start and then in the order of ``kinds``.  Null texts have none."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__body", body)
    hits = [f"__hits_{k.name}" for k in kinds]
    for k, name in zip(kinds, hits):
        df = df.withColumn(name, F.when(k.hint(F.col("__body")), F.regexp_extract_all("__body", F.lit(k.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    each = [F.filter(placed(F.col("__body"), k.pattern, F.col(name), k.name, rank), _holding(k)) for rank, (k, name) in enumerate(zip(kinds, hits))]
    return df.withColumn(out, F.when(sum((F.size(name) for name in hits), F.lit(0)) > 0, F.array_sort(F.concat(*each))).otherwise(no_spans())).drop("__body", *hits)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """``text`` with each span (sorted; one that begins within another is skipped) replaced by ``mark(kind)``."""

    def step(state: Column, s: Column) -> Column:
        out = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), mark(s["kind"]))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(s["end"].alias("at"), out.alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
