"""Interval algebra on half-open spans (structs with start and stop) and the conflict rule of findall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def span(start: Column | int, stop: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(start).cast("int").alias("start"), lit(stop).cast("int").alias("stop"))


def length(s: Column) -> Column:
    return F.greatest(s["stop"] - s["start"], F.lit(0))


def is_empty(s: Column) -> Column:
    return s["stop"] <= s["start"]


def contains(s: Column, position: Column) -> Column:
    return (s["start"] <= position) & (position < s["stop"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def touches(a: Column, b: Column) -> Column:
    return (a["stop"] == b["start"]) | (b["stop"] == a["start"])


def merge(a: Column, b: Column) -> Column:
    """The hull of two spans that overlap or touch, else null."""
    hull = span(F.least(a["start"], b["start"]), F.greatest(a["stop"], b["stop"]))
    return F.when(overlaps(a, b) | touches(a, b), hull)


def resolve(spans: DataFrame, key: str = "doc_id", start: str = "start", stop: str = "stop") -> DataFrame:
    """Spans of each document without conflicts.

    In order of start, then of falling stop, a span counts if it reaches further than all before it; of those, one that
    overlaps its successor gives way to it. A chain of overlaps so keeps its last span alone.
    """
    order = Window.partitionBy(key).orderBy(F.col(start), F.col(stop).desc())
    furthest = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    records = spans.withColumn("__furthest", furthest).filter(F.col("__furthest").isNull() | (F.col(stop) > F.col("__furthest")))
    following = records.withColumn("__next", F.lead(start).over(order))
    return following.filter(F.col("__next").isNull() | (F.col("__next") >= F.col(stop))).drop("__furthest", "__next")


def resolve_local(spans: list[tuple[int, int]]) -> list[int]:
    """Indices of the spans that stay, by the same rule."""
    kept: list[int] = []
    furthest = None
    for i in sorted(range(len(spans)), key=lambda i: (spans[i][0], -spans[i][1])):
        start, stop = spans[i]
        if furthest is not None and stop <= furthest:
            continue
        if kept and spans[kept[-1]][1] > start:
            kept.pop()
        kept.append(i)
        furthest = stop
    return kept
