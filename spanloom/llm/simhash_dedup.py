"""SimHash near-dedup with deletion-variant signatures.

Fingerprints of 64 bits link at 2 or fewer differing bits. Cut into two segments of 32 bits, at least one segment of
a linked pair differs by at most one bit, so the pair shares a signature (segment, wildcard position, other 31 bits).
Each distinct fingerprint is indexed under its 64 signatures, an equality join finds candidates, and the Hamming
distance verifies them. Copies never multiply: the join is over distinct fingerprints.

A segment value held by very many fingerprints would make one bucket quadratic. Such fingerprints are joined among
themselves by signatures with two wildcards over all 64 bits: equal ones differ in those two bits at most, so a
bucket holds four fingerprints at most. Both ways are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import connected_components, keep_by_key, limit_batches, written

WORDS, MAX_BITS = 3, 2
#: Different fingerprints with the same segment value from which their bucket is split by two-wildcard signatures.
HOT_BUCKET = 512
_LOWER = {i: i + 32 for i in range(65, 91)}
_WEIGHTS = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned SimHash of a text's word shingles, repeats included; 0 without words (and for null)."""
    if not text:
        return 0
    lowered = text.lower() if text.isascii() else text.translate(_LOWER)
    parts = lowered.encode("utf-8", "surrogatepass").split()
    n = len(parts) - words + 1
    if not parts:
        return 0
    shingles = [b" ".join(parts)] if n < 1 else map(b" ".join, zip(*(parts[i:] for i in range(words))))
    n = max(n, 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):  # a very long text unpacks 4 MB at a time
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_WEIGHTS[2 * ones > n].sum(dtype=np.uint64))


def fingerprint_column(text_col: str | Column, words: int = WORDS) -> Column:
    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py(), words) for t in texts), dtype=np.uint64, count=len(texts))
        return pa.array(found.view(np.int64))

    return prints(F.col(text_col) if isinstance(text_col, str) else text_col)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def one_wildcard(prints: DataFrame) -> DataFrame:
    """64 rows a fingerprint: key = segment, wildcard position and the segment without that bit, packed in a long."""
    segment = F.when(F.col("j") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    bit = F.expr("shiftleft(1L, j % 32)")
    key = F.expr("shiftleft(cast(j as long), 32)").bitwiseOR(segment.bitwiseAND(F.bitwise_not(bit)))
    rows = prints.withColumn("j", F.explode(F.array(*[F.lit(i) for i in range(64)])))
    return rows.withColumn("key", key).withColumn("hot", F.when(F.col("j") < 32, F.col("hot_low")).otherwise(F.col("hot_high"))).select("key", "fp", "hot")


def two_wildcards(prints: DataFrame) -> DataFrame:
    """2016 rows a fingerprint: (pair of positions, the fingerprint without those two bits)."""
    masks = [(1 << i | 1 << j) for i in range(64) for j in range(i)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = prints.select("fp", F.explode(F.array(*[F.lit(m) for m in signed])).alias("mask"))
    return rows.select("mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest"), "fp")


def links(prints: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b), a < b: all pairs of a table of distinct fingerprints ``fp`` that differ in at most two bits.

    The joins of signatures are merged by hint: Spark's estimate of an exploded table leaves out the 64 or 2016 rows a
    fingerprint, so that it would broadcast a table far over its threshold, through the driver.
    """
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    segments = prints.select(F.explode(F.array(F.struct(F.lit(0).alias("s"), low.alias("v")), F.struct(F.lit(1).alias("s"), high.alias("v")))).alias("x")).select("x.*")
    hot = written(segments.groupBy("s", "v").count().filter(F.col("count") > hot_bucket).select("s", "v"), "hot")
    any_hot = hot.limit(1).count() > 0
    if not any_hot:
        keyed = one_wildcard(prints.withColumns({"hot_low": F.lit(False), "hot_high": F.lit(False)})).drop("hot")
        a, b = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
        return a.join(b.hint("merge"), "key").filter((F.col("a") < F.col("b")) & (_distance("a", "b") <= MAX_BITS)).select("a", "b").distinct()
    lows = hot.filter("s = 0").select(F.col("v").alias("__low"), F.lit(True).alias("__in_low"))
    highs = hot.filter("s = 1").select(F.col("v").alias("__high"), F.lit(True).alias("__in_high"))
    marked = prints.join(lows, low == F.col("__low"), "left").join(highs, high == F.col("__high"), "left")
    marked = written(marked.select("fp", F.col("__in_low").isNotNull().alias("hot_low"), F.col("__in_high").isNotNull().alias("hot_high")), "marked")
    keyed = one_wildcard(marked)
    # a cold fingerprint's bucket is bounded on its side; pairs that are hot on both sides come from two wildcards
    a = keyed.filter("not hot").select("key", F.col("fp").alias("a"))
    b = keyed.select("key", F.col("fp").alias("b"), F.col("hot").alias("b_hot"))
    cold = a.join(b.hint("merge"), "key").filter((F.col("b_hot") & (F.col("a") != F.col("b")) | (F.col("a") < F.col("b"))) & (_distance("a", "b") <= MAX_BITS))
    pairs = two_wildcards(marked.filter("hot_low or hot_high"))
    both = pairs.withColumnRenamed("fp", "a").join(pairs.withColumnRenamed("fp", "b").hint("merge"), ["mask", "rest"]).filter("a < b")
    found = cold.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(both.select("a", "b"))
    return found.distinct()


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """doc_id, text_hash, fp (signed), root, component_id for each row of ``df``; texts are read once.

    root is the least fingerprint of the component and names it: unlinked components can share a component_id.
    component_id is the smallest doc_id that links reach; rows without doc_id take part, and have component_id
    null only if no row that they reach has one. Null and empty texts have fingerprint 0 and link like any other.
    Repeated rows have equal fingerprints and so the same component. An empty table gives no rows. No table that grows with
    ``df`` is broadcast.
    """
    limit_batches(df.sparkSession)
    slim = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), fingerprint_column(text_col, words).alias("fp"))
    slim = written(slim, "prints")
    prints = slim.select("fp").distinct()
    nodes = connected_components(links(prints, hot_bucket)).withColumnsRenamed({"node": "fp", "component": "root"})
    nodes = written(nodes, "components")
    rooted = slim.join(nodes.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least.hint("merge"), "root").select("doc_id", "text_hash", "fp", "root", "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``df`` with one document of each group: the one with the least doc_id, rows without doc_id last.

    If several rows of a group have that doc_id, the one with the least text hash stays, and one of equal rows. An empty table
    stays empty; columns may have any names.
    """
    groups = written(near_groups(df, id_col, text_col, hot_bucket=hot_bucket).select("doc_id", "text_hash", "root"), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = groups.groupBy("root").agg(F.min(place).alias("first"))
    decided = groups.join(first.hint("merge"), "root").select("doc_id", "text_hash", (place == F.col("first")).alias("keep"))
    return keep_by_key(df, {"doc_id": F.col(id_col), "text_hash": F.xxhash64(F.col(text_col))}, decided, "near")
