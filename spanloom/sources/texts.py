"""Text sources: one document a row as (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.errors import TokenizerError
from spanloom.functions.tokens import TOKEN


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document a line. doc_id is unique but depends on the file layout."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document a file; doc_id is a hash of its path."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def table(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", format: str = "parquet") -> DataFrame:
    """Any format that Spark reads, with the two columns pruned in the scan."""
    return spark.read.format(format).load(path).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def spread(docs: DataFrame) -> DataFrame:
    """Documents over all cores: a table of fewer files than cores is dealt out, as a file may be one row group, which one
    task reads; tables of many files stay as they are, without a shuffle."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if len(docs.inputFiles()) < cores else docs


def pretokenised(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with a tokens array from one row a token (key, idx, value, token_type, byte and char spans)."""
    need = ["idx", "value", "token_type", "byte_start", "byte_stop", "char_start", "char_stop"]
    missing = [c for c in [key, *need] if c not in rows.columns]
    if missing:
        raise TokenizerError(f"token rows lack {', '.join(missing)}")
    own = [F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in [*need, "forms", "tag"]]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*own).cast(TOKEN)), lambda a, b: a["idx"] - b["idx"]).alias("tokens"))
