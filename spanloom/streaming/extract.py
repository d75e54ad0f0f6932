"""Extraction over streams of documents: every verb is stateless, so a stream takes the batch plan as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators.engine import Parser


def stream_matches(docs: DataFrame, parser: Parser, text_col: str = "text") -> DataFrame:
    """findall over a streaming DataFrame. Array and chart plans have no shuffle and keep no state."""
    return parser.findall(docs, text_col)


def stream_facts(docs: DataFrame, parser: Parser, text_col: str = "text") -> DataFrame:
    return parser.facts(docs, text_col=text_col)


def each_batch(docs: DataFrame, plan: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, **options) -> StreamingQuery:
    """Run any batch plan (lexicon joins, relational strategy) on each micro-batch; the sink is Parquet by batch number.

    A batch that is repeated after a failure overwrites its own folder, so each document's rows appear once.
    """

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
