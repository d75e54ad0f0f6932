"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

The permutation is a bijection on 0..N-1 that depends on N and the seed alone; a row's shard and slot follow from its
number without any table, and the inverse leads back from (shard, slot) to the row number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import with_row_number

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) as the round function."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    with np.errstate(over="ignore"):
        return [int(_mix(np.array([seed * 1_000_003 + r], dtype=np.uint64), 0x9E3779B97F4A7C15)[0]) for r in range(ROUNDS)]


def _half_bits(n: int) -> int:
    return max(1, ((n - 1).bit_length() + 1) // 2)


def permute(rows: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Images of row numbers in 0..n-1. The domain has under 4 n values; those beyond n walk on till they fall inside."""
    half = np.uint64(_half_bits(n))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _keys(seed)
    out = np.asarray(rows).astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        left, right = out[todo] >> half, out[todo] & mask
        for key in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, key) & mask), left
            else:
                left, right = right, left ^ (_mix(right, key) & mask)
        out[todo] = left << half | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def permuted(column: Column, n: int, seed: int) -> Column:
    @F.arrow_udf("long")
    def images(rows: pa.Array) -> pa.Array:
        return pa.array(permute(rows.to_numpy(zero_copy_only=False), n, seed))

    return images(column)


def feistel_shards(df: DataFrame, order: list[Column], n_shards: int, seed: int = 42) -> DataFrame:
    """``df`` with row_number, position, shard and slot; columns of these names are replaced, all others may have any names.

    ``order`` fixes the row numbers, so that reruns and other file layouts give the same result; rows that tie in it
    are interchangeable. Shard sizes differ by one at most and slots of a shard are gapless from 0. Project to the
    columns that must travel before the call: the rows are range-partitioned once. An empty table stays empty.
    """
    numbered, n = with_row_number(df, order)
    placed = numbered.withColumn("position", permuted(F.col("row_number"), max(n, 1), seed))
    return placed.withColumns({"shard": (F.col("position") % n_shards).cast("int"), "slot": F.floor(F.col("position") / n_shards).cast("long")})


def locate(shard: int, slot: int, n: int, n_shards: int, seed: int = 42) -> int:
    """The row number at (shard, slot), computed back without any data."""
    return int(permute(np.array([slot * n_shards + shard]), n, seed, inverse=True)[0])
