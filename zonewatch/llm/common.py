"""What the corpus operators share: tables, size-checked joins, fixed-size counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewatch.session import materialize

#: Words as the contracts define them: runs of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a lookup side that may be broadcast; each such row is a few numbers or short strings.
BROADCAST_ROWS = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches have at most so many rows from now on: rows here are whole texts, and a batch
    of ten thousand of them is held several times over on its way through a Python task."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting, "10000")) <= rows:
        spark.conf.set(setting, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def lookup_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written lookup table, broadcast if it has at most `max_rows` rows; a larger one is joined
    by key, where Spark splits the hot keys of the other side at run time."""
    kept = materialize(df)
    return F.broadcast(kept) if kept.limit(max_rows + 1).count() <= max_rows else kept


def fixed_counts(df: DataFrame, cells: int, indexes: Callable[[pa.RecordBatch], Iterator[np.ndarray]],
                 slices: int = 64) -> np.ndarray:
    """Counts of cell numbers over all rows, as one array of `cells` numbers.

    Each task adds up its own array and hands on `slices` pieces of it; the pieces are summed where
    they meet, one running array per slice. Nothing here grows with the rows but the number of tasks.
    """
    return add_pieces(df.mapInArrow(counting(cells, indexes, slices), "slice int, piece binary"), cells, slices)


def counting(cells: int, indexes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], slices: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int32)
        for batch in batches:
            for found in indexes(batch):
                total += np.bincount(found, minlength=cells).astype(np.int32)
        yield pieces_of(total, slices)
    return run


def pieces_of(total: np.ndarray, slices: int) -> pa.RecordBatch:
    rows = [(i, x.tobytes()) for i, x in enumerate(np.split(total, slices)) if x.any()]
    return pa.record_batch([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())],
                           names=["slice", "piece"])


def add_pieces(pieces: DataFrame, cells: int, slices: int = 64) -> np.ndarray:
    width = cells // slices

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = sums.setdefault(i, np.zeros(width, dtype=np.int64))
                at += np.frombuffer(x, dtype=np.int32)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
                              names=["slice", "piece"])

    out = np.zeros(cells, dtype=np.int64)
    spark = pieces.sparkSession
    summed = pieces.repartition(min(slices, partitions(spark)), "slice").mapInArrow(add, "slice int, piece binary")
    for row in summed.collect():  # `cells` numbers, whatever the input
        out[row["slice"] * width:(row["slice"] + 1) * width] += np.frombuffer(row["piece"], dtype=np.int64)
    return out
