"""Sharding by a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_names, materialize, release, table

ROUNDS = 6
#: Rows of a range of the row numbering, about; a row per range is broadcast (100,000 at 100 billion rows).
SLICE = 1_000_000


class Permutation:
    """A keyed bijection of 0..n-1: a balanced Feistel network over the least even number of bits that holds n, whose
    outputs of n and more are fed in again until they fall below n (cycle walking)."""

    def __init__(self, n: int, seed: int) -> None:
        self.n = n
        self.half = max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.keys = [int.from_bytes(hashlib.blake2b(f"{seed}/{r}".encode(), digest_size=8).digest(), "little") for r in range(ROUNDS)]

    def _round(self, x: np.ndarray, key: int) -> np.ndarray:
        y = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        y ^= y >> np.uint64(32)
        y *= np.uint64(0xD6E8FEB86659FD93)
        y ^= y >> np.uint64(29)
        return y & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        a, b = x >> half, x & mask
        for k in reversed(self.keys) if back else self.keys:
            a, b = (b ^ self._round(a, k), a) if back else (b, a ^ self._round(b, k))
        return (a << half) | b

    def _walk(self, x, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), back)
        while len(over := np.flatnonzero(out >= self.n)):
            out[over] = self._once(out[over], back)
        return out.astype(np.int64)

    def forward(self, x) -> np.ndarray:
        return self._walk(x, False)

    def inverse(self, x) -> np.ndarray:
        return self._walk(x, True)

    def place(self, row: int, shards: int) -> tuple[int, int]:
        """Shard and slot of a row number, without the table."""
        p = int(self.forward(np.array([row]))[0])
        return p % shards, p // shards


def number_rows(rows: DataFrame, *order: str, n: int | None = None) -> DataFrame:
    """Adds row, a gapless number from 0: the place in the order of the columns order, nulls first (equal rows are
    interchangeable).

    Rows are sorted in ranges of some SLICE rows (n: their number, counted where it isn't given); a row's number is the
    count of all ranges before its own plus its place there. The place in the input is the last key of the ranges, so
    that rows equal in all of order are split among ranges too; rows must read alike each time. Numbers don't depend on
    where the ranges end. A column row of the input that isn't in order is replaced; all other columns stay.
    """
    spark = rows.sparkSession
    at_, part_, place_, first_, before_ = free_names(rows, "at", "part", "place", "first", "before")
    parts = max(spark.sparkContext.defaultParallelism, -(-(rows.count() if n is None else n) // SLICE))
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranged = rows.withColumn(at_, F.monotonically_increasing_id()).repartitionByRange(parts, *keys, at_).sortWithinPartitions(*keys, at_)
    ordered = materialize(ranged.drop(at_).withColumns({part_: F.spark_partition_id(), place_: F.monotonically_increasing_id()}))
    counts = ordered.groupBy(part_).agg(F.min(place_).alias(first_), F.count("*").alias(before_))
    earlier = Window.orderBy(part_).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = counts.withColumn(before_, F.coalesce(F.sum(before_).over(earlier), F.lit(0)))
    return ordered.join(F.broadcast(counts), part_).withColumn("row", F.col(before_) + F.col(place_) - F.col(first_)).drop(part_, place_, first_, before_)


def shard(rows: DataFrame, shards: int, *order: str, seed: int = 11) -> DataFrame:
    """Adds row, shard and slot: row numbers permuted, then dealt in turn.

    Counts of shards differ by one at most and slots are gapless from 0. Reruns over the same rows agree. Nulls order
    first; an empty table gives an empty result. Columns row, shard and slot of the input are replaced, all others stay.
    The permutation alone gives shard and slot of any row number (Permutation.place) and the row of any shard and slot
    (inverse).
    """
    rows = materialize(rows)
    n = rows.count()
    permutation = Permutation(n, seed)
    numbered = number_rows(rows, *order, n=n)
    release(rows)

    @F.pandas_udf("long")
    def permute(x: pd.Series) -> pd.Series:
        return pd.Series(permutation.forward(x.to_numpy()))

    (p,) = free_names(numbered, "p")
    out = numbered.withColumn(p, permute("row"))
    return out.withColumns({"shard": (F.col(p) % shards).cast("int"), "slot": F.expr(f"{p} div {shards}")}).drop(p)


def op8_feistel_sharding(spark, sf_dir: str) -> DataFrame:
    """Law `rows`: each shard's count is at most one from any other's."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard(rows, 8, "doc_id", "size", "text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_feistel_sharding": op8_feistel_sharding}
ORACLES: dict[str, str] = {}
