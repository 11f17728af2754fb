"""Session helpers: construction for local runs, shared storage, size checks."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS_CONF = "spark.zonewatch.hotRows"
DEFAULT_HOT_ROWS = 5_000_000
_TRACKED: list[list[DataFrame]] = []


def local_session(cores: str = "8", app: str = "zonewatch", **conf: str) -> SparkSession:
    """A session for tests and benches. On a cluster, pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. On one machine a temporary one will do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(sc, "_zonewatch_shared"):  # the setting itself cannot be changed in a running session
        sc._zonewatch_shared = tempfile.mkdtemp(prefix="spark-zonewatch-")
    return sc._zonewatch_shared


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing a table into the shared folder and reading it back.

    Unlike a cached or locally checkpointed frame, the files outlive lost executors,
    and the reader keeps column pruning and size statistics. See `release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/zonewatch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._zonewatch_path = path
    for made in _TRACKED:
        made.append(kept)
    return kept


@contextmanager
def tables_made() -> Iterator[list[DataFrame]]:
    """The tables that `materialize` makes in this block, so that they can be released when its result is written."""
    made: list[DataFrame] = []
    _TRACKED.append(made)
    try:
        yield made
    finally:
        _TRACKED[:] = [m for m in _TRACKED if m is not made]


def release(*tables: DataFrame) -> None:
    """Delete tables made by `materialize`, once nothing that is still to run reads them. Once more does no harm."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._zonewatch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def dealt_by_some_keys(spark: SparkSession) -> Iterator[None]:
    """Joins that are run in this block also use sides that are dealt out by some of the join's keys, as groupings do."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hot_rows(spark: SparkSession) -> int:
    """Rows of one key that a single task may be given."""
    return int(spark.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


def largest_group(df: DataFrame, by: list[str]) -> int:
    """Row count of the biggest key. Only one number reaches the driver."""
    if by:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    else:
        sizes = df.agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def has_hot_group(df: DataFrame, by: list[str], limit: int | None = None) -> bool:
    """Whether some key holds more rows than one task should take.

    Rows are counted per key, combined map-side, over the key columns alone.
    """
    return largest_group(df, by) > (limit or hot_rows(df.sparkSession))


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Broadcast a written side once its row count is known to be small; else leave the
    choice of join to Spark. For sides whose rows have a bounded size."""
    kept = materialize(df)
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python tasks, once per application.

    Nothing is sent where workers find it anyway: it is installed, on PYTHONPATH, or in the folder in
    which a local session runs.
    """
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    found = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.master.startswith("local["):
        found.append(os.getcwd())
    if top in found or "site-packages" in top or getattr(sc, "_zonewatch_shipped", False):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="spark-zonewatch-"), "zonewatch")  # read by the driver alone
    sc.addPyFile(shutil.make_archive(base, "zip", top, os.path.basename(os.path.dirname(os.path.abspath(__file__)))))
    sc._zonewatch_shipped = True
