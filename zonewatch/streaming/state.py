"""Zone state as tables: save, inspect, and load for the current grids only."""

from __future__ import annotations

import pickle
import warnings

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewatch import schemas
from zonewatch.operators.replay import replay
from zonewatch.operators.zone_scan import KEY, clean_row, complete_scans, zone_step
from zonewatch.params import ScanParams
from zonewatch.streaming.scan import SNAPSHOT


def final_states(scans: DataFrame, params: ScanParams) -> DataFrame:
    """State of each zone after the given scans, as one packed row per zone."""

    def step(state, cols):
        out = []
        names = list(cols)
        for values in zip(*cols.values()):
            state, _ = zone_step(state, clean_row(dict(zip(names, values))), params)
            out.append(None)
        if out:
            out[-1] = pickle.dumps(state, protocol=4)
        return state, {"state": out}

    rows = replay(complete_scans(scans), KEY, ["t_s", "scan_no"], step, "state binary",
                  keep=[*KEY, "t_s", "scan_no"]).filter("state is not null")
    # a zone may span batches; its newest packed state is the final one
    last = rows.groupBy(*KEY).agg(F.max_by("state", F.struct("t_s", "scan_no")).alias("state"))
    return last.withColumn("sig", F.pandas_udf(_signature, "string")("state")).select(*SNAPSHOT.names)


def _signature(states: pd.Series) -> pd.Series:
    """Grid signature of packed states; null for a zone without a state."""
    found = [pickle.loads(s) if s is not None else None for s in states]
    return pd.Series([None if s is None else s["sig"] for s in found], dtype=object)


def save_state(states: DataFrame, path: str) -> None:
    states.select(*SNAPSHOT.names).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str, grids: DataFrame | None = None) -> DataFrame:
    """Saved states; with `grids` (camera_id, zone_id, sig) only those of the current grid.

    A folder that does not exist gives no rows, so the zones start empty; so does a snapshot whose files
    cannot be decoded, with a warning. Other failures (no permission, a lost file system) are raised.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SNAPSHOT)
    df = spark.read.schema(SNAPSHOT).parquet(path)
    try:
        df.agg(F.count("state")).first()
    except Exception as e:
        if not any(sign in str(e) for sign in ("CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "FAILED_READ_FILE", "corrupt")):
            raise
        warnings.warn(f"the snapshot at {path} cannot be decoded, zones start empty: {str(e)[:200]}", stacklevel=2)
        return spark.createDataFrame([], SNAPSHOT)
    return df if grids is None else df.join(grids.select(*KEY, "sig"), [*KEY, "sig"], "left_semi").select(*SNAPSHOT.names)


def _unpack(states: DataFrame, schema, rows_of) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for cam, zone, packed in zip(pdf["camera_id"], pdf["zone_id"], pdf["state"]):
                s = pickle.loads(packed)
                if s is not None and len(s["ids"]):
                    base = pd.DataFrame({"row": s["ids"] >> 32, "col": s["ids"] & 0xFFFFFFFF})
                    base.insert(0, "sig", s["sig"])
                    base.insert(0, "zone_id", zone)
                    base.insert(0, "camera_id", cam)
                    yield rows_of(base, s)[schema.names]
    return states.select(*KEY, "state").mapInPandas(run, schema)


def unpack_reference(states: DataFrame) -> DataFrame:
    def rows_of(base, s):
        base["desc"] = list(s["ref"])
        return base[s["known"]]
    return _unpack(states, schemas.REF_STATE, rows_of)


def unpack_clutter(states: DataFrame) -> DataFrame:
    def rows_of(base, s):
        return base.assign(total=s["total"], litter=s["litter"], clean_streak=s["streak"], muted=s["muted"])
    return _unpack(states, schemas.CLUTTER_STATE, rows_of)
