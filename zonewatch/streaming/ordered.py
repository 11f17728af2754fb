"""Streams worked off in event-time order, whatever order rows arrive in: scans with control orders, and episodes.

Rows of a key wait in list state until the watermark has passed them; Spark drops what arrives later than that. Then
they are taken in order of time, so the result is that of a batch run, for any arrival order within the delay, and
for any cut into micro-batches. A timer at the earliest waiting row brings a key back once its rows are due; there is
no work for keys that wait. What waits of a key is what arrived within the delay.

Scans and control orders come as one stream (`with_orders`): both are rows of their zone. Rows of kind `tick` carry
nothing but time: sent now and then, they let the watermark pass when no zone reports.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from zonewatch import schemas
from zonewatch.operators.zone_scan import KEY, clean_row, zone_step
from zonewatch.params import ScanParams
from zonewatch.streaming.scan import RESULT, ROCKSDB

#: event: scan, idle or removed. snapshot: the packed state of the zone, where one is due.
ORDERED = T.StructType([*RESULT.fields, T.StructField("control", T.StringType()), T.StructField("event", T.StringType()),
                        T.StructField("snapshot", T.BinaryType())])


class InOrder(StatefulProcessor):
    """Keeps rows until the watermark has passed them and hands them to `take` in order of `at_us`, `nth_at` and order text."""

    out: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("at", T.LongType()), T.StructField("row", T.BinaryType())]))
        self.kept = handle.getValueState("kept", T.StructType([T.StructField("data", T.BinaryType()), T.StructField("timer", T.LongType())]))

    def take(self, key, state, row: dict) -> tuple[object, list[dict]]:
        """One row: (state, row) -> (state, results)."""
        raise NotImplementedError

    def due(self, state) -> int | None:
        """When (microseconds) the state wants to be looked at without a row."""
        return None

    def expire(self, key, state, upto: int) -> tuple[object, list[dict]]:
        """Nothing came up to `upto`, where the state was due."""
        return state, []

    def settle(self, key, state) -> list[dict]:
        """What to tell once all rows that are due were taken."""
        return []

    def _held(self) -> tuple[object, int | None]:
        held = self.kept.get() if self.kept.exists() else None
        return (pickle.loads(held[0]) if held and held[0] is not None else None, held[1] if held else None)

    def _hold(self, state, timer: int | None) -> None:
        if state is None and timer is None:
            self.kept.clear()
        else:
            self.kept.update((pickle.dumps(state, protocol=4) if state is not None else None, timer))

    def _wake(self, at: int | None, timer: int | None) -> int | None:
        """Registers a timer (milliseconds) for `at` unless an earlier one is set."""
        if at is None:
            return timer
        ms = -(-at // 1000)
        if timer is None or ms < timer:
            self.handle.registerTimer(ms)
            return ms
        return timer

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        if len(initialState):
            state = self.start(pickle.loads(bytes(initialState["state"].iloc[0])))
            self._hold(state, self._wake(self.due(state), None))

    def start(self, saved):
        return saved

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for chunk in rows:
            chunk = chunk[chunk["nth_at"] >= 0] if len(chunk) else chunk  # ticks do not wait
            if len(chunk):
                records = chunk.to_dict("records")
                self.waiting.appendList([(int(r["at_us"]), pickle.dumps(r, protocol=4)) for r in records])
                first = min(int(chunk["at_us"].min()), first if first is not None else 1 << 62)
        if first is not None:
            state, timer = self._held()
            later = self._wake(first, timer)
            if later != timer:
                self._hold(state, later)
        yield pd.DataFrame([], columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        state, timer = self._held()
        ready, rest = [], []
        for at, row in (self.waiting.get() if self.waiting.exists() else ()):
            (ready if at <= upto else rest).append((at, row))
        out = []
        for r in sorted((pickle.loads(row) for _, row in ready), key=lambda r: (r["at_us"], r["nth_at"], r.get("control") or "")):
            at = self.due(state)
            if at is not None and at < r["at_us"]:
                state, more = self.expire(key, state, r["at_us"] - 1)
                out += more
            state, more = self.take(key, state, r)
            out += more
        at = self.due(state)
        if at is not None and at <= upto:
            state, more = self.expire(key, state, upto)
            out += more
        out += self.settle(key, state)
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        timer = None if timer is None or timer * 1000 <= upto else timer
        ahead = [a for a in (min((a for a, _ in rest), default=None), self.due(state)) if a is not None]
        self._hold(state, self._wake(min(ahead), timer) if ahead else timer)
        yield pd.DataFrame(out, columns=self.out, dtype=object)

    def close(self) -> None:
        pass


class OrderedZones(InOrder):
    """The zone scan over scans and orders. An order counts for the first scan at or after it, the last one if there
    are several. With `idle_s`, a zone without a scan for longer is forgotten, and a row says so. With
    `snapshot_every`, the state comes along at each so many scans of a zone, and with alerts."""

    out = ORDERED.names

    def __init__(self, params: ScanParams, idle_s: float | None = None, snapshot_every: int | None = None):
        self.params, self.idle_s, self.every = params, idle_s, snapshot_every

    def start(self, saved):
        # when a saved zone was last seen is known in its own time only; idle time counts from its next scan
        return {"scan": saved, "order": None, "n": 0, "last": None}

    def take(self, key, state, row):
        state = state or self.start(None)
        if row["nth_at"] == 0:
            return {**state, "order": row["control"]}, []
        row = clean_row({**row, "control": state["order"] or row["control"]})
        had = state["scan"] is not None
        scan, res = zone_step(state["scan"], row, self.params)
        gone = scan is None
        n = 0 if gone else state["n"] + (not res["late"])
        saves = self.every is not None and not gone and not res["late"] and (n % self.every == 0 or res["alert"])
        out = {**{c: row[c] for c in (*KEY, "scan_no", "t_s", "sig", "n_cells")}, **res, "control": row["control"],
               "event": "removed" if gone and had else "scan", "snapshot": pickle.dumps(scan, protocol=4) if saves else None}
        # a removed zone leaves nothing behind
        return (None if gone else {"scan": scan, "order": None, "n": n, "last": row["at_us"]}), [out]

    def due(self, state):
        if self.idle_s is None or state is None or state["last"] is None or state["scan"] is None:
            return None
        return state["last"] + round(self.idle_s * 1e6)

    def expire(self, key, state, upto):
        row = {c: None for c in self.out}
        row.update(zip(KEY, key), t_s=state["scan"]["last_t"] + self.idle_s, event="idle", sig=state["scan"]["sig"])
        # an order that waits for the next scan goes on waiting
        return ({**self.start(None), "order": state["order"]} if state["order"] else None), [row]


def with_orders(scans: DataFrame, control: DataFrame | None = None, event_time: str = "ts") -> DataFrame:
    """One stream of scans and control orders (camera_id, zone_id, order, event time)."""
    rows = scans.select(*[(F.col(f.name) if f.name in scans.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.SCANS.fields],
                        F.col(event_time).alias("ts"), F.lit("scan").alias("kind"))
    if control is None:
        return rows
    orders = control.select(*KEY, F.col("order").alias("control"), F.col(event_time).alias("ts"), F.lit("order").alias("kind"))
    return rows.unionByName(orders, allowMissingColumns=True)


def _ordered(rows: DataFrame, key: list[str], processor: InOrder, out: T.StructType, event_time: str, delay: str, nth: Column,
             initial: DataFrame | None) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = rows.withWatermark(event_time, delay).withColumns({"at_us": F.unix_micros(event_time), "nth_at": nth})
    return timed.groupBy(*key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime",
        initialState=initial.groupBy(*key) if initial is not None else None)


def zones_in_order(rows: DataFrame, params: ScanParams, delay: str = "10 minutes", initial: DataFrame | None = None,
                   idle_s: float | None = None, snapshot_every: int | None = None) -> DataFrame:
    """The zone scan over a stream of `with_orders`, in event-time order. `initial`: saved states (`SNAPSHOT`)."""
    # of one time, orders come before scans; of several orders the greatest text is last
    nth = F.when(F.col("kind") == "tick", -1).when(F.col("kind") == "order", 0).otherwise(1 + F.coalesce("scan_no", F.lit(0)))
    return _ordered(rows, KEY, OrderedZones(params, idle_s, snapshot_every), ORDERED, "ts", delay, nth.cast("bigint"), initial)


class Episodes(InOrder):
    """Alert episodes of a key: from the first alert that is no escalation, while none is open, to the scan that
    re-arms. An open one is kept over batches; whenever rows came, a row tells how it stands."""

    def __init__(self, key: list[str]):
        self.key = key
        self.out = [*key, "episode", "t_start", "t_end", "n_alerts", "max_hot", "version"]

    def _row(self, key, state, t_end=None):
        o = state["open"]
        return {**dict(zip(self.key, key)), "episode": state["episode"], "t_start": o["t_start"], "t_end": t_end,
                "n_alerts": o["n_alerts"], "max_hot": o["max_hot"], "version": state["version"]}

    def take(self, key, state, row):
        s = dict(state or {"episode": 0, "version": 0, "open": None, "told": True})
        out = []
        if s["open"] is None and row["alert"] and not row["escalated"]:
            s.update(episode=s["episode"] + 1, open={"t_start": row["t_s"], "n_alerts": 0, "max_hot": row["n_hot"]})
        if s["open"] is not None:
            o = s["open"]
            s["open"] = {**o, "n_alerts": o["n_alerts"] + bool(row["alert"]), "max_hot": max(o["max_hot"], row["n_hot"])}
            s.update(version=s["version"] + 1, told=False)
            if row["rearmed"]:
                out.append(self._row(key, s, row["t_s"]))
                s.update(open=None, told=True)
        return s, out

    def settle(self, key, state):
        if state is None or state["told"]:
            return []
        state["told"] = True
        return [self._row(key, state)]


def episodes_in_order(scans: DataFrame, by: list[str], event_time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Alert episodes of a stream of scan results (t_s, scan_no, alert, escalated, rearmed, n_hot). An episode comes again
    as it grows; the row with the highest `version` holds (`latest_episodes`, or a status table). Rows without a key
    or with scan_no below 0 only carry time."""
    out = T.StructType([*[scans.schema[c] for c in by], T.StructField("episode", T.LongType()), T.StructField("t_start", T.DoubleType()),
                        T.StructField("t_end", T.DoubleType()), T.StructField("n_alerts", T.LongType()),
                        T.StructField("max_hot", scans.schema["n_hot"].dataType), T.StructField("version", T.LongType())])
    return _ordered(scans, by, Episodes(by), out, event_time, delay, F.coalesce("scan_no", F.lit(-1)).cast("bigint"), None)


def latest_episodes(rows: DataFrame, by: list[str]) -> DataFrame:
    rest = ["t_start", "t_end", "n_alerts", "max_hot"]
    return rows.groupBy(*by, "episode").agg(F.max_by(F.struct(*rest), "version").alias("s")).select(*by, "episode", "s.*")
