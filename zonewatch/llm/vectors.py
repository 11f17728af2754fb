"""Whole-number vectors for the exact searches: quantising, copies, matrices, pieces of a table that meet.

A vector is held as bytes of 32-bit whole numbers, so equal vectors are equal keys. Vectors of different
lengths are compared as if the shorter one went on with zeros.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewatch.llm.common import partitions
from zonewatch.llm.hashing import text_bytes

#: Squared length from which a vector takes no part: inner products of shorter ones fit a long.
MAX_SQUARES = 2.0 ** 62
#: Whole numbers up to which doubles are exact.
EXACT = 2.0 ** 53
#: Rows of a table, and queries, that one task meets at a time on large tables.
CHUNK_ROWS, BLOCK_QUERIES = 65_536, 4_096
#: Rows for which a further piece of a small table is worth a task.
LEAST_ROWS = 1_024


def quantised(df: DataFrame, scale: int) -> DataFrame:
    """Rows (id, label, asked, vec) of rows (id, label, asked, embedding): each component is floor(scale * x), x as double.

    Rows whose embedding is null, holds a null, NaN or an infinity, or has a squared length of 2^62 or more
    after scaling are left out; an embedding without components is a vector (its scores are 0).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("embedding")
            at, values = col.offsets.to_numpy().astype(np.int64), col.values.to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(values * float(scale))
                bad = ~(np.abs(x) < 2.0 ** 31)
                x[bad] = 0.0
                squares = np.append(0.0, np.cumsum(x * x))
            bads = np.append(0, np.cumsum(bad))
            good = (bads[at[1:]] == bads[at[:-1]]) & (squares[at[1:]] - squares[at[:-1]] < MAX_SQUARES)
            good &= ~col.is_null().to_numpy(zero_copy_only=False)
            packed = pa.Array.from_buffers(pa.binary(), len(col), [None, pa.py_buffer((at * 4).astype(np.int32)),
                                                                   pa.py_buffer(x.astype("<i4"))])
            keep = pa.array(good)
            yield pa.record_batch([*(batch.column(c).filter(keep) for c in ("id", "label", "asked")), packed.filter(keep)],
                                  names=["id", "label", "asked", "vec"])
    rows = df.select(F.col("id").cast("long"), F.col("label").cast("long"), F.coalesce("asked", F.lit(False)).alias("asked"),
                     F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "id long, label long, asked boolean, vec binary")


def first_ids(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """One row per distinct `by`, with its k smallest ids (nulls last, repeats kept) as `ids`. Copies are cut to
    k before they are shuffled, so a vector that a third of all rows share is no large group."""
    order = Window.partitionBy(*by).orderBy(F.col("id").asc_nulls_last())
    few = rows.withColumn("nth_", F.row_number().over(order)).filter(F.col("nth_") <= k)
    entry = F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("no"), "id")))
    return few.groupBy(*by).agg(F.transform(entry, lambda x: x["id"]).alias("ids"))


def matrix(col: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """The vectors as rows of whole numbers, at least `width` wide."""
    raw, at = text_bytes(col)
    lengths = np.diff(at) // 4
    flat = np.frombuffer(raw[at[0]:at[-1]].tobytes(), dtype="<i4").astype(np.int64)
    d = max(width, int(lengths.max(initial=0)))
    if len(lengths) and lengths.min() == d:
        return flat.reshape(len(lengths), d)
    out = np.zeros((len(lengths), d), dtype=np.int64)
    out[np.arange(d) < lengths[:, None]] = flat
    return out


def matrices(a, b) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of two columns, equally wide."""
    x, y = matrix(a), matrix(b)
    d = max(x.shape[1], y.shape[1])
    return tuple(np.pad(z, ((0, 0), (0, d - z.shape[1]))) if z.shape[1] < d else z for z in (x, y))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products, exact: by doubles where they cannot be rounded."""
    bound = math.sqrt(float((q.astype(float) ** 2).sum(1).max(initial=0))) * math.sqrt(float((x.astype(float) ** 2).sum(1).max(initial=0)))
    if bound < EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


class Ids:
    """The id lists of some rows, each sorted, nulls last."""

    def __init__(self, col: pa.ChunkedArray):
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        self.at = col.offsets.to_numpy().astype(np.int64)
        self.none = col.values.is_null().to_numpy(zero_copy_only=False)
        self.ids = col.values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first, self.first_none = self.ids[self.at[:-1]], self.none[self.at[:-1]]

    def best(self, score: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The k first entries of `rows` by score, ties by id: scores, ids, whether the id is null, and rows.
        An entry among the first k is of one of the first k rows by score and smallest id."""
        if len(rows) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            near = score >= cut
            score, rows = score[near], rows[near]
            order = np.lexsort((self.first[rows], self.first_none[rows], -score))[:k]
            score, rows = score[order], rows[order]
        n = self.at[rows + 1] - self.at[rows]
        of = np.repeat(np.arange(len(rows)), n)
        at = np.repeat(self.at[rows] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        order = np.lexsort((self.ids[at], self.none[at], -score[of]))[:k]
        of, at = of[order], at[order]
        return score[of], self.ids[at], self.none[at], rows[of]


def id_array(ids: np.ndarray, none: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=none)


def pieces(n: Column, rows: int, tasks: int) -> Column:
    """Pieces of a table of n rows: of `rows` at most on average; at least `tasks`, if that leaves LEAST_ROWS."""
    least = F.least(F.lit(tasks).cast("long"), F.ceil(n / F.lit(LEAST_ROWS)))
    return F.greatest(F.ceil(n / F.lit(rows)), least, F.lit(1).cast("long")).cast("int")


def tasks(df: DataFrame) -> int:
    return 2 * partitions(df.sparkSession)


def piece_of(key: str, n: Column) -> Column:
    """Number of the piece of a row among n, by a hash of its (distinct) vector."""
    return F.pmod(F.xxhash64(key), n.cast("long")).cast("int")


def each_piece(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))
