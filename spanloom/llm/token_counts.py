"""Token counts from an exact length histogram.

Documents are counted by encoded length; suffix sums over the histogram then answer totals, quantiles and truncated totals
for every context limit without another look at the documents.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.bpe import load
from spanloom.llm.common import limit_batches

#: Lengths of a block of the suffix sums.
BLOCK = 4096


def length_column(text_col: str | Column, path: str) -> Column:
    @F.arrow_udf("long")
    def lengths(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        return pa.array([len(bpe.encode(t.as_py())) // 4 for t in texts], type=pa.int64())

    return lengths(F.col(text_col) if isinstance(text_col, str) else text_col)


def length_histogram(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many rows of ``df`` have each encoded length. Null and empty texts have length 0."""
    limit_batches(df.sparkSession)
    return df.select(length_column(text_col, path).alias("n_tokens")).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with docs_ge and tokens_ge (of documents at least as long), n_total and tokens_total.

    For a limit L equal to a row's n_tokens, truncated = sum of min(length, L); other limits: :func:`at_limits`.
    Sums run within blocks of BLOCK lengths and over block totals, so no task holds the whole histogram: an inner
    window sees at most BLOCK rows, the outer one row a block. An empty table gives no rows.
    """
    h = histogram.withColumns({"tokens": F.col("n_tokens") * F.col("n_docs"), "block": F.floor(F.col("n_tokens") / BLOCK).cast("long")})
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    above, whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    blocks = totals.select(
        "block",
        F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("block_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("block_docs").over(whole).alias("n_total"),
        F.sum("block_tokens").over(whole).alias("tokens_total"),
    )
    inner = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.withColumns({"docs_ge": F.sum("n_docs").over(inner), "tokens_ge": F.sum("tokens").over(inner)}).join(blocks, "block")
    out = out.withColumns({"docs_ge": F.col("docs_ge") + F.col("docs_above"), "tokens_ge": F.col("tokens_ge") + F.col("tokens_above")})
    truncated = F.col("tokens_total") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")
    share = (F.col("n_total") - F.col("docs_ge") + F.col("n_docs")) / F.col("n_total")
    return out.select("n_tokens", "n_docs", "docs_ge", "tokens_ge", truncated.alias("truncated_total"), share.alias("quantile"), "n_total", "tokens_total")


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context, documents over it, and the total after truncation to it, for any limits (a short list)."""
    wanted = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context long")
    longer = F.when(F.col("n_tokens") > F.col("context"), F.col("n_docs"))
    kept = F.least("n_tokens", "context") * F.col("n_docs")
    return F.broadcast(wanted).join(sums.select("n_tokens", "n_docs"), F.lit(True), "left").groupBy("context").agg(
        F.coalesce(F.sum(longer), F.lit(0)).alias("docs_over"), F.coalesce(F.sum(kept), F.lit(0)).alias("truncated_total")
    )


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that at least a share ``q`` of the documents do not exceed; None for an empty table."""
    return sums.filter(F.col("quantile") >= q).agg(F.min("n_tokens")).first()[0]
