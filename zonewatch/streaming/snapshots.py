"""Snapshots of zone states from a running stream, in a folder with versions and one pointer.

Each micro-batch with due states writes them into a folder of its own number, so a batch that runs again overwrites what it
wrote, and then moves the pointer, a small file that is replaced by renaming. Readers follow the pointer: they see
a batch wholly or not at all. Every `fold` batches the newest state of each zone is written as a new base, so that a
restart does not read the whole history.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewatch.operators.zone_scan import KEY
from zonewatch.streaming.scan import SNAPSHOT

_STORED = [*SNAPSHOT.names, "t_s"]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_pointer(spark: SparkSession, path: str) -> dict | None:
    """{"base": number of the base folder or None, "parts": later folders, oldest first}."""
    p, fs = _fs(spark, f"{path}/CURRENT")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _move_pointer(spark: SparkSession, path: str, pointer: dict) -> None:
    jvm = spark._jvm
    new, fs = _fs(spark, f"{path}/CURRENT.new")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(pointer), "utf-8"))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(new, _fs(spark, f"{path}/CURRENT")[0], options)


def _newest(rows: DataFrame) -> DataFrame:
    """Per zone its newest row; without a state the zone is gone."""
    return rows.groupBy(*KEY).agg(F.max_by(F.struct("sig", "state", "t_s"), F.struct("batch", "t_s", F.col("state").isNull().alias("gone"))).alias("s")).select(*KEY, "s.*")


def _versions(spark: SparkSession, path: str, pointer: dict) -> DataFrame:
    # the order of folders is theirs in the pointer, not that of their numbers: a new query counts from 0 again
    folders = ([f"base={pointer['base']}"] if pointer["base"] is not None else []) + [f"part={n}" for n in pointer["parts"]]
    frames = [spark.read.parquet(f"{path}/{f}").withColumn("batch", F.lit(i)) for i, f in enumerate(folders)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def save_snapshots(path: str, rows_path: str | None = None, fold: int = 20, run: str = "0") -> Callable[[DataFrame, int], None]:
    """foreachBatch function for rows of `zones_in_order`: keeps due states below `path`, and all rows below
    `rows_path`. `run` names the query: a restart from its own checkpoint keeps the name, a new query takes another."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        if rows_path:
            batch.drop("snapshot").write.mode("overwrite").parquet(f"{rows_path}/run={run}/batch={epoch}")
        due = batch.filter("snapshot IS NOT NULL OR event IN ('removed', 'idle')")
        states = _newest(due.select(*KEY, "sig", F.col("snapshot").alias("state"), "t_s", F.lit(0).alias("batch")))
        name, pointer = f"{run}-{epoch}", read_pointer(spark, path) or {"base": None, "parts": []}
        if name in pointer["parts"] or due.limit(1).count():
            states.write.mode("overwrite").parquet(f"{path}/part={name}")
            parts = [p for p in pointer["parts"] if p != name] + [name]
            pointer = {"base": pointer["base"], "parts": parts}
            if len(parts) >= fold:
                _newest(_versions(spark, path, pointer)).filter("state IS NOT NULL").write.mode("overwrite").parquet(f"{path}/base={name}")
                pointer = {"base": name, "parts": []}
            _move_pointer(spark, path, pointer)
        batch.unpersist()
    return write


def load_snapshots(spark: SparkSession, path: str, grids: DataFrame | None = None) -> DataFrame:
    """The newest saved state of each zone (`SNAPSHOT`), with the time of its last scan; with `grids` (camera_id,
    zone_id, sig) only of zones whose grid is still the same. Nothing saved: no rows."""
    pointer = read_pointer(spark, path)
    if pointer is None or (pointer["base"] is None and not pointer["parts"]):
        return spark.createDataFrame([], SNAPSHOT).withColumn("t_s", F.lit(None).cast("double"))
    states = _newest(_versions(spark, path, pointer)).filter("state IS NOT NULL").select(*_STORED)
    return states if grids is None else states.join(grids.select(*KEY, "sig"), [*KEY, "sig"], "left_semi").select(*_STORED)
