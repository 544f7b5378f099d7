"""Reproducible shuffled shards: a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of (doc_id, CRC, size).  A balanced
Feistel network over the smallest even number of bits that holds n, walked until
it lands below n, permutes the numbers.  Position p of the permutation is slot
``p // n_shards`` of shard ``p % n_shards``, so any row's place can be computed
from its number alone, and back (``row_at``).

Law ``rows``: the shards' row counts differ by one at most.  Equal texts form a
group, ``text_group`` (64 bits of hash), and are dealt like other rows: a group
that holds a third of all rows can't stay together under this law.
Null texts count as empty (size 1, CRC 0); null ids sort first; repeated rows
each get a place of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round_value(half: np.ndarray, key: int) -> np.ndarray:
    x = half + np.uint64(key)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> list[int]:
    return [(seed * 0x2545F4914F6CDD1D + r * 0x9E3779B97F4A7C15 + 1) % (1 << 63) for r in range(ROUNDS)]


def _walk(values, n: int, seed: int, inverse: bool) -> np.ndarray:
    out = np.asarray(values).astype(np.uint64)
    bits = np.uint64(_half_bits(n))
    mask = np.uint64((1 << int(bits)) - 1)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for key in reversed(_keys(seed)) if inverse else _keys(seed):
            if inverse:
                left, right = right ^ (_round_value(left, key) & mask), left
            else:
                left, right = right, left ^ (_round_value(right, key) & mask)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def permuted(rows, n: int, seed: int) -> np.ndarray:
    """Positions of row numbers in the shuffled order of n rows."""
    return _walk(rows, n, seed, inverse=False)


def row_at(positions, n: int, seed: int) -> np.ndarray:
    """Row numbers at the given positions; the inverse of ``permuted``."""
    return _walk(positions, n, seed, inverse=True)


def shard(docs: DataFrame, n_shards: int = 8, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, text_group of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    order = ["doc_id", "text_crc32", "size"]
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("text_group"),
    )
    # partition and position are written down, so that a lost executor can't renumber rows
    placed = written(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "*",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
        ),
        "sharding",
    )
    # one row for each partition, however many rows the table has
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    parts = sorted(counts)
    starts = dict(zip(parts, np.cumsum([0, *(counts[p] for p in parts)])[:-1].tolist(), strict=True))
    n = sum(counts.values())

    @F.pandas_udf("long")
    def position(part: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series(permuted(part.map(starts).to_numpy() + at.to_numpy(), n, seed))

    return placed.withColumn("position", position("part", "at")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("position", F.lit(n_shards)).cast("int").alias("shard"),
        F.expr(f"position div {n_shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "text_group",
    )
