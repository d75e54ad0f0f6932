"""Mixing sources to target weights by repetition rates.

Words are summed per source, targets follow by capped proportional shares, a source's rate is target / words, and each
document is taken floor(rate) times plus once more if its seeded hash falls below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import column, free_names, small_side, with_row_number, word_count, written

WEIGHTS, CAP, SEED = (1, 2, 3), 3, 42
#: Salts of a source's rows when the source table is too large to broadcast.
SALTS = 32


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, weight, target for a table (source, size).

    Sources in order of code points, null last, have the weights in turn. They share all words by weight; a target
    stops at ``cap`` times its source's words and the excess is shared again by weight until none is above. Each
    round caps at least one more source; only three sums a round reach the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked, n = with_row_number(totals, [F.col("source").asc_nulls_last()], "__rank")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    table = written(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    left, shared = None, None
    everything = int(table.agg(F.sum("source_size")).first()[0] or 0)
    limit = F.col("source_size") * cap
    while n:
        share = F.lit(True) if left is None else F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(shared)) <= limit
        open_, taken = table.agg(F.sum(F.when(share, F.col("weight"))), F.sum(F.when(~share, limit))).first()
        now = (everything - int(taken or 0), int(open_ or 0))
        if now == (left, shared) or not now[1]:
            break
        left, shared = now
    fair = F.col("weight").cast("double") * F.lit(float(left or 0)) / F.lit(float(shared or 1))
    return table.withColumn("target", F.least(fair, limit.cast("double")))


def unit_hash(seed: int, *cols: Column) -> Column:
    """52 bits of an MD5 over the seed and the columns (null as a text of its own), in [0, 1)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _planned(df: DataFrame, targets: DataFrame, id_col: str, source_col: str, seed: int) -> tuple[DataFrame, str, str, str]:
    """``df`` with the source's size, its target and the row's copies, and the names of these columns, which are new.

    The source table is broadcast if small (counted and measured); else rows are salted, so that a hot source spreads over
    SALTS keys.
    """
    own, total, target, copies, salt, row_salt = free_names(df, "__source", "__source_size", "__target", "__copies", "__salt", "__row_salt")
    table = written(targets.select(F.col("source").alias(own), F.col("source_size").alias(total), F.col("target").alias(target)), "targets")
    side = small_side(table)
    on = column(source_col).eqNullSafe(F.col(own))
    if side is table:
        side = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        df = df.withColumn(row_salt, F.pmod(F.xxhash64(column(id_col)), F.lit(SALTS)).cast("int"))
        on = on & (F.col(row_salt) == F.col(salt))
    rate = F.when(F.col(total) > 0, F.col(target) / F.col(total)).otherwise(F.lit(0.0))
    extra = (unit_hash(seed, column(id_col)) < rate - F.floor(rate)).cast("long")
    return df.join(side, on).withColumn(copies, F.floor(rate) + extra), total, target, copies


def slim_sizes(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size of each row, written once."""
    return written(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")), "sizes")


def plan_mix(sizes: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target (of the row's source) and copies, how often the mix takes the row.

    ``sizes`` is a table of :func:`slim_sizes`: it is read for the sums and again for the decisions. A null text has
    size 0; rows that share an id get the same decision, so reruns and other layouts agree. A source without words
    has target 0 and its rows are taken 0 times. An empty table stays empty.
    """
    planned, total, target, copies = _planned(sizes, source_targets(sizes), "doc_id", "source", seed)
    return planned.select("doc_id", "source", "size", F.col(total).alias("source_size"), F.col(target).alias("target"), F.col(copies).alias("copies"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The mixed corpus: each row of ``df`` as often as the plan takes it, with the columns of ``df``.

    The targets come from a slim pass over (source, size); the texts themselves do not shuffle. Null texts, null sources,
    rows of one id and an empty table go as in :func:`plan_mix`; other columns may have any names.
    """
    targets = source_targets(df.select(column(source_col).alias("source"), word_count(text_col).alias("size")))
    planned, _, _, copies = _planned(df, targets, id_col, source_col, seed)
    (copy,) = free_names(planned, "__copy")
    repeated = planned.filter(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return repeated.select(*map(column, df.columns))
