"""Drive a stream over what is available and hand back the written result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewatch.session import materialize, release, shared_dir
from zonewatch.sinks.writers import write_scan_log
from zonewatch.streaming.metrics import BatchCounts


ROWS_PER_FILE = 200_000


def stage_input(df: DataFrame, ranges: int, order: list[str], by: list[str], rows_per_file: int = ROWS_PER_FILE) -> str:
    """Write rows as consecutive ranges of the order, one range after the other.

    A file stream takes files by their time, so the ranges arrive in order. Within a range the rows of a
    key are in one file; the number of files follows the number of rows.
    """
    ranged = materialize(df.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()))
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stream-in-{uuid.uuid4().hex}"
    for i in range(ranges):
        part = ranged.filter(F.col("_part") == i).drop("_part")
        part.repartition(max(1, -(-part.count() // rows_per_file)), *by).write.mode("append").parquet(path)
    release(ranged)
    return path


def stage_batches(df: DataFrame, batch: str, numbers: list[int]) -> str:
    """Write the rows of each number in `batch` as one file, one number after the other: a file stream that takes a
    file at a time delivers them in this order. For inputs whose batches are part of the case."""
    kept = materialize(df)
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stream-in-{uuid.uuid4().hex}"
    for n in numbers:
        kept.filter(F.col(batch) == n).drop(batch).coalesce(1).write.mode("append").parquet(path)
    release(kept)
    return path


def _with_partitions(spark, partitions: int | None, start):
    """Start a query with this number of state partitions, which it keeps for life, and wait for its end."""
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(partitions or spark.sparkContext.defaultParallelism))
    try:
        start().awaitTermination()
    finally:
        spark.conf.set(setting, before)


def drain(stream: DataFrame, sink, checkpoint: str, partitions: int | None = None) -> None:
    """Process everything there is with a foreachBatch sink, and stop."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    _with_partitions(stream.sparkSession, partitions, writer.start)


def run_available(stream: DataFrame, partitions: int | None = None, counts: BatchCounts | None = None) -> DataFrame:
    """Process everything there is into Parquet, stop, and read it back. `counts` follows the query.

    A stream keeps its number of state partitions for life, so it is set here on purpose
    (default: the cores at hand) and not left to the session's shuffle setting.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-out-{uuid.uuid4().hex}"
    name = f"run-{uuid.uuid4().hex}"
    if counts is not None:
        counts.follow(name)
    _with_partitions(spark, partitions, lambda: write_scan_log(stream, f"{base}/rows", f"{base}/checkpoint", once=True, name=name))
    if counts is not None:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
