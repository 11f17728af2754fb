"""Structured Streaming form of the zone scan: the same step, state kept per zone."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from zonewatch import schemas
from zonewatch.operators.zone_scan import KEY, clean_row, complete_scans, zone_step
from zonewatch.params import ScanParams

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = T.StructType([T.StructField("camera_id", T.StringType()), T.StructField("zone_id", T.StringType()),
                       T.StructField("scan_no", T.LongType()), T.StructField("t_s", T.DoubleType()),
                       T.StructField("sig", T.StringType()), T.StructField("n_cells", T.IntegerType()),
                       *schemas.SCAN_RESULT.fields])
SNAPSHOT = T.StructType([T.StructField("camera_id", T.StringType()), T.StructField("zone_id", T.StringType()),
                         T.StructField("sig", T.StringType()), T.StructField("state", T.BinaryType())])


class ZoneProcessor(StatefulProcessor):
    """One packed state per zone; a zone left alone for `ttl_ms` is forgotten."""

    def __init__(self, params: ScanParams, ttl_ms: int | None = None):
        self.params, self.ttl_ms = params, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("state", T.BinaryType())])
        self.state = handle.getValueState("zone", schema, self.ttl_ms)

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        if len(initial):
            self.state.update((bytes(initial["state"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        state = pickle.loads(held[0]) if held is not None else None
        # one micro-batch of one zone: a few scans, put in time order before stepping
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["t_s", "scan_no"])
        out = []
        for row in batch.to_dict("records"):
            state, res = zone_step(state, clean_row(row), self.params)
            out.append({**{c: row[c] for c in (*KEY, "scan_no", "t_s", "sig", "n_cells")}, **res})
        if state is None:
            self.state.clear()
        else:
            self.state.update((pickle.dumps(state, protocol=4),))
        yield pd.DataFrame(out, columns=RESULT.names)

    def close(self) -> None:
        pass


def scan_stream(scans: DataFrame, params: ScanParams, event_time: str | None = None,
                watermark: str = "10 minutes", initial: DataFrame | None = None,
                ttl_ms: int | None = None) -> DataFrame:
    """Streaming scans in, scan results out (append). Rows not after the zone's last scan
    come out flagged `late` and change nothing; older than the watermark they are dropped."""
    spark = scans.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if event_time:
        scans = scans.withWatermark(event_time, watermark)
    start = initial.groupBy(*KEY) if initial is not None else None
    return complete_scans(scans).groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=ZoneProcessor(params, ttl_ms), outputStructType=RESULT, outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None", initialState=start)


def windowed_report(scans: DataFrame, event_time: str, by: list[str], minutes: int = 30,
                    watermark: str = "1 hour") -> DataFrame:
    """Tumbling report of a stream of scan results."""
    return (scans.withWatermark(event_time, watermark)
            .groupBy(*by, F.window(event_time, f"{minutes} minutes"))
            .agg(F.count(F.lit(1)).alias("n_scans"), F.count_if(F.col("n_hot") > 0).alias("n_with_hot"),
                 F.count_if("alert").alias("n_alerts"), F.avg("n_changed").alias("mean_changed"))
            .select(*by, F.col("window.start").alias("start"), "n_scans", "n_with_hot", "n_alerts", "mean_changed"))


def alert_sessions(scans: DataFrame, event_time: str, by: list[str], gap: str = "10 minutes",
                   watermark: str = "1 hour") -> DataFrame:
    """Alerts grouped into episodes by a time gap."""
    return (scans.filter("alert").withWatermark(event_time, watermark)
            .groupBy(*by, F.session_window(event_time, gap))
            .agg(F.count(F.lit(1)).alias("n_alerts"), F.max("n_hot").alias("max_hot"))
            .select(*by, F.col("session_window.start").alias("start"),
                    F.col("session_window.end").alias("end"), "n_alerts", "max_hot"))
