"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

A frequent-items sketch (the Misra-Gries family, ``approx_top_k``) over the digests finds every digest that may hold a
large share of the rows. Exact counts and winners of those few are computed with map-side combine and broadcast, so their
rows are decided where they are and never meet in one task. All other digests shuffle by digest as usual.
The sketch only chooses the path: both paths are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import WHITE, keep_by_key, text_or_empty, written

#: Most digests that the broadcast can hold, and counters of the sketch: no other digest has over about rows / TRACKED rows.
TOP, TRACKED = 512, 8192


def normalised(text: str | Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(text_or_empty(text), WHITE, " ")


def text_digest(text: str | Column) -> Column:
    return F.sha2(normalised(text), 256)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Slim (doc_id, text_sha256, row) of every row, written once: the texts are read and hashed a single time."""
    slim = df.select(F.col(id_col).alias("doc_id"), text_digest(text_col).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    return written(slim, "digests")


def decide(slim: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of :func:`digests`.

    Of equal texts the row with the smallest doc_id stays (a null doc_id is larger than all); of rows that also
    tie in doc_id exactly one stays. An empty table gives no rows.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    frequent = slim.agg(F.expr(f"approx_top_k(text_sha256, {TOP}, {TRACKED})").alias("top")).select(F.explode("top.item").alias("text_sha256"))
    hot = slim.join(F.broadcast(frequent), "text_sha256", "left_semi")  # TOP rows at most
    winners = written(hot.groupBy("text_sha256").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "winners")
    split = slim.join(F.broadcast(winners), "text_sha256", "left")
    group = Window.partitionBy("text_sha256")
    rest = split.filter(F.col("first").isNull()).select("doc_id", "row", "text_sha256", first.over(group).alias("first"), F.count(F.lit(1)).over(group).alias("group_size"))
    done = split.filter(F.col("first").isNotNull()).select("doc_id", "row", "text_sha256", "first", "group_size")
    return done.unionByName(rest).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256"
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df`` with its group's decision; see :func:`decide`. Other columns are ignored."""
    return decide(digests(df, id_col, text_col))


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without copies: all columns of the rows that stay. Columns may have any names; see :func:`decide` for nulls, ties,
    repeated rows and empty tables."""
    decided = exact_dedup(df, id_col, text_col).select("doc_id", "text_sha256", F.col("kept").alias("keep"))
    return keep_by_key(df, {"doc_id": F.col(id_col), "text_sha256": text_digest(text_col)}, decided, "copies")
