"""Operator 4: sharding by a Feistel permutation of global row numbers, with cycle walking.

Rows get global numbers 0 .. n-1 in an order fixed by their values alone. A keyed permutation of those
numbers gives each row its place in a reproducible shuffle; the place modulo the shard count is its
shard, the place divided by it its slot. Anyone who knows n, the key and a row number can compute shard
and slot (`place_of`), and go back from a place to the row number (`row_at`), without the data.

The permutation works on pairs (l, r) with l < a, r < b and a*b just above n: each round adds a keyed
function of one half to the other. Numbers that leave 0 .. n-1 are permuted again until they are back.

Shards differ by at most one row (law `rows`), so equal texts are not held together: a group may be a
third of all rows, more than a shard.

Numbering: distinct rows are counted first, so repeats are one row until the end; the counts are added
up within hash buckets of bounded size and over the buckets. Rows alike in all columns take consecutive
numbers and are interchangeable. Nulls order first and are values like others; an empty table gives an
empty result; helper columns clash with none of the table's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewatch.llm.common import lookup_side

SHARDS = 16
ROUNDS = 8
BUCKET_ROWS = 50_000
PRIME = (1 << 31) - 1


def round_keys(key: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Two numbers below 2^31 - 1 for each round, from a linear congruence."""
    out, x = [], (key * 48271 + 11) % PRIME or 1
    for _ in range(rounds):
        pair = []
        for _ in range(2):
            x = x * 48271 % PRIME
            pair.append(x)
        out.append((pair[0], pair[1]))
    return out


def _stir(v: np.ndarray, keys: tuple[int, int]) -> np.ndarray:
    """A fixed function of a half, for halves below 2^31; every product stays below 2^62."""
    x = (v % PRIME * keys[0] + keys[1]) % PRIME
    x = (x * x + v) % PRIME
    return (x * keys[0] + keys[1]) % PRIME


def _halves(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(n))
    return a, -(-n // a)


def place_of(number: np.ndarray, n: int, key: int = 4) -> np.ndarray:
    """The places of row numbers below n, each in 0 .. n-1 and each taken once."""
    a, b = _halves(n)
    x, out = np.asarray(number, dtype=np.int64), np.empty(len(number), dtype=np.int64)
    left = np.arange(len(x))
    while len(left):
        l, r = x // b, x % b
        for i, k in enumerate(round_keys(key)):
            if i % 2:
                r = (r + _stir(l, k)) % b
            else:
                l = (l + _stir(r, k)) % a
        x = l * b + r
        home = x < n
        out[left[home]] = x[home]
        left, x = left[~home], x[~home]
    return out


def row_at(place: np.ndarray, n: int, key: int = 4) -> np.ndarray:
    """The row numbers at places: the inverse of `place_of`."""
    a, b = _halves(n)
    x, out = np.asarray(place, dtype=np.int64), np.empty(len(place), dtype=np.int64)
    left = np.arange(len(x))
    while len(left):
        l, r = x // b, x % b
        for i, k in reversed(list(enumerate(round_keys(key)))):
            if i % 2:
                r = (r - _stir(l, k)) % b
            else:
                l = (l - _stir(r, k)) % a
        x = l * b + r
        home = x < n
        out[left[home]] = x[home]
        left, x = left[~home], x[~home]
    return out


def numbered(rows: DataFrame, name: str = "number_") -> tuple[DataFrame, int]:
    """`rows` with global numbers, and how many rows there are."""
    columns = rows.columns
    n = rows.count()
    buckets = max(1, min(1 << 20, n // BUCKET_ROWS + 1))
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(buckets))
    distinct = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("times_")).withColumn("bucket_", bucket)
    totals = rows.select(bucket.alias("bucket_")).groupBy("bucket_").agg(F.count(F.lit(1)).alias("rows_"))
    before = Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    base = lookup_side(totals.select("bucket_", F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("base_")))
    within = Window.partitionBy("bucket_").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = (distinct.withColumn("at_", F.coalesce(F.sum("times_").over(within), F.lit(0))).join(base, "bucket_")
              .withColumn(name, F.explode(F.sequence(F.col("base_") + F.col("at_"), F.col("base_") + F.col("at_") + F.col("times_") - 1))))
    return placed.select(*columns, name), n


def feistel_shards(rows: DataFrame, shards: int = SHARDS, key: int = 4, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """`rows` with shard (int) and slot (long, gapless from 0 within a shard)."""
    placed, n = numbered(rows)

    @F.pandas_udf("long")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series(place_of(x.to_numpy(), n, key))

    placed = placed.withColumn("number_", place("number_"))
    return placed.select(*rows.columns, (F.col("number_") % shards).cast("int").alias(shard_col),
                         F.floor(F.col("number_") / shards).cast("long").alias(slot_col))
