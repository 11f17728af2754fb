"""Queries over streams that are worked off in event-time order: control orders, idle zones, snapshots, late rows, episodes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from zonewatch.catalog.base import LOG, query
from zonewatch.catalog.more import GATE, PLAIN
from zonewatch.catalog.reports import BY
from zonewatch.catalog.scans import SCORE, THR, zone_scans
from zonewatch.params import ScanParams
from zonewatch.session import shared_dir
from zonewatch.sources import bindings as B
from zonewatch.streaming import metrics as M
from zonewatch.streaming import ordered as O
from zonewatch.streaming import run as R
from zonewatch.streaming import snapshots as SN
from zonewatch.streaming import state as ST

#: Seconds at which the streams start; a watermark starts at 0, and what is not after it is late.
START = 1_000_000


def _timed(df):
    return df.withColumn("ts", F.timestamp_seconds(F.col("t_s") + START))


def _delivered(spark, rows, batches: int, end_s: float):
    """Rows as a stream of micro-batches by their column `batch`, and a tick at the end that lets all of them be done."""
    tick = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ("ts", "kind", "batch")],
                                 F.timestamp_seconds(F.lit(end_s + START)).alias("ts"), F.lit("tick").alias("kind"), F.lit(batches).alias("batch"))
    path = R.stage_batches(rows.unionByName(tick), "batch", list(range(batches + 1)))
    return spark.readStream.schema(rows.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(path)


ORDERS = """o AS (SELECT CAST(vec_id // 125 AS VARCHAR) AS camera_id, vec_id % 125 * 5.0::DOUBLE + 5 AS t_s FROM embeddings WHERE vec_id % 40 = 7)"""


@query("control_stream", f"""WITH RECURSIVE {GATE.split('run AS (')[0]} n AS (SELECT camera_id, scan_no, count(*) FILTER (NOT visible) AS n_occluded FROM c GROUP BY ALL),
{ORDERS}, s AS (SELECT DISTINCT camera_id, scan_no, scan_no*30.0::DOUBLE AS t_s FROM c),
w AS (SELECT DISTINCT o.camera_id, s.scan_no FROM o ASOF JOIN s ON o.camera_id=s.camera_id AND o.t_s <= s.t_s),
z AS (SELECT s.*, w.scan_no IS NOT NULL AS ordered, count(w.scan_no) OVER (PARTITION BY s.camera_id ORDER BY s.scan_no) AS resets FROM s LEFT JOIN w USING (camera_id, scan_no)),
v AS (SELECT q.*, z.resets FROM q JOIN z USING (camera_id, scan_no)),
run AS (
  SELECT camera_id, label, scan_no, rn, resets, d AS ref, true AS first, false AS changed, CAST(0 AS BIGINT) AS run FROM v WHERE rn = 1
  UNION ALL
  SELECT q.camera_id, q.label, q.scan_no, q.rn, q.resets, CASE WHEN x.f THEN q.d WHEN x.s >= {THR} THEN run.ref
      ELSE list_transform(range(1,65), lambda i: 0.95::DOUBLE*run.ref[i] + 0.05::DOUBLE*q.d[i]) END, x.f,
    NOT x.f AND x.s >= {THR}, CASE WHEN NOT x.f AND x.s >= {THR} THEN run.run + 1 ELSE 0 END
  FROM run JOIN v q ON q.camera_id=run.camera_id AND q.label=run.label AND q.rn=run.rn+1,
  LATERAL (SELECT {SCORE.format(a='q.d', b='run.ref')} AS s, q.resets <> run.resets AS f) x)
SELECT n.camera_id, n.scan_no, CASE WHEN z.ordered THEN 'reset' END AS control, n.n_occluded::INTEGER AS n_occluded,
  count(*) FILTER (run.first OR run.changed)::INTEGER AS n_changed, count(*) FILTER (run.run >= 2)::INTEGER AS n_hot
FROM n JOIN z USING (camera_id, scan_no) LEFT JOIN run USING (camera_id, scan_no) GROUP BY ALL""")
def control_stream(spark, sf):
    """Scans and reset orders in one stream; rows come up to two micro-batches after their time."""
    scans = _timed(zone_scans(spark, sf))
    v = F.col("vec_id")
    orders = _timed(B.table(spark, sf, "embeddings").filter("vec_id % 40 = 7").select(
        F.floor(v / 125).cast("string").alias("camera_id"), F.lit("z0").alias("zone_id"), (v % 125 * 5.0 + 5).alias("t_s"), F.lit("reset").alias("order")))
    rows = O.with_orders(scans, orders)
    part = F.floor((F.unix_seconds("ts") - START) / 150) + F.pmod(F.hash("camera_id", "ts"), F.lit(3))
    stream = _delivered(spark, rows.withColumn("batch", F.least(part, F.lit(6)).cast("int")), 7, 100_000)
    out = R.run_available(O.zones_in_order(stream, PLAIN, "600 seconds"))
    return out.select("camera_id", "scan_no", "control", "n_occluded", "n_changed", "n_hot")


@query("idle_zones", """WITH c AS (SELECT CAST(vec_id // 125 AS VARCHAR) AS camera_id, row_number() OVER (PARTITION BY vec_id // 125, label ORDER BY vec_id) AS scan_no FROM embeddings),
s AS (SELECT DISTINCT camera_id, scan_no * 30.0::DOUBLE + scan_no // 6 * 400 AS t_s FROM c),
g AS (SELECT *, lead(t_s) OVER (PARTITION BY camera_id ORDER BY t_s) AS ahead FROM s)
SELECT camera_id, t_s + 300 AS t_s FROM g WHERE ahead IS NULL OR ahead - t_s > 300""")
def idle_zones(spark, sf):
    """Scans with a gap after every sixth: zones are forgotten 300 s after their last scan."""
    scans = zone_scans(spark, sf).withColumn("t_s", F.col("scan_no") * 30.0 + F.floor(F.col("scan_no") / 6) * 400)
    rows = O.with_orders(_timed(scans)).withColumn("batch", F.least(F.floor(F.col("scan_no") / 4), F.lit(4)).cast("int"))
    out = R.run_available(O.zones_in_order(_delivered(spark, rows, 5, 1_000_000), PLAIN, "0 seconds", idle_s=300.0))
    return out.filter("event = 'idle'").select("camera_id", "t_s")


CALM = ScanParams(thr=THR, mode="change_only", dwell=2, guard_frac=2.0, clutter_on=False, min_hot=1_000_000)


@query("stream_snapshot", """WITH c AS (SELECT CAST(vec_id // 125 AS VARCHAR) AS camera_id, label, row_number() OVER (PARTITION BY vec_id // 125, label ORDER BY vec_id) AS scan_no,
  embedding[1] < 0.25 AS visible FROM embeddings),
l AS (SELECT camera_id, max(scan_no) // 5 * 5 AS upto FROM c GROUP BY camera_id)
SELECT camera_id, upto * 30.0::DOUBLE AS t_s, count(DISTINCT label) FILTER (visible AND scan_no <= upto) AS n_known FROM c JOIN l USING (camera_id) WHERE upto > 0 GROUP BY camera_id, upto""")
def stream_snapshot(spark, sf):
    """What a stream has saved of its zones: the state at each fifth scan, and how many references that holds."""
    base = f"{shared_dir(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    rows = O.with_orders(_timed(zone_scans(spark, sf))).withColumn("batch", F.least(F.floor(F.col("scan_no") / 4), F.lit(4)).cast("int"))
    stream = O.zones_in_order(_delivered(spark, rows, 5, 1_000_000), CALM, "0 seconds", snapshot_every=5)
    R.drain(stream, SN.save_snapshots(f"{base}/states", fold=3), f"{base}/checkpoint")
    states = SN.load_snapshots(spark, f"{base}/states")
    known = ST.unpack_reference(states).groupBy("camera_id").agg(F.count(F.lit(1)).alias("n_known"))
    return states.join(known, "camera_id", "left").select("camera_id", "t_s", F.coalesce("n_known", F.lit(0)).alias("n_known"))


DELIVERY = """CASE WHEN (scan_no * 5 + CAST(camera_id AS BIGINT)) % 9 = 4 THEN 3 ELSE 0 END"""


@query("late_rows", f"""WITH c AS (SELECT DISTINCT CAST(vec_id // 125 AS VARCHAR) AS camera_id, row_number() OVER (PARTITION BY vec_id // 125, label ORDER BY vec_id) AS scan_no FROM embeddings),
s AS (SELECT *, scan_no * 30 AS t, least(scan_no // 4 + {DELIVERY}, 7) AS batch FROM c),
b AS (SELECT batch, max(t) AS top FROM s GROUP BY batch),
f AS (SELECT s.*, coalesce((SELECT max(top) FROM b WHERE b.batch <= s.batch - 2), -1) AS passed FROM s)
SELECT count(*) + 1 AS n_rows, count(*) FILTER (t <= passed) AS n_late FROM f""")
def late_rows(spark, sf):
    """Some scans come three micro-batches late. Those behind the watermark (that of the batch before) are counted."""
    base = f"{shared_dir(spark).rstrip('/')}/late-{uuid.uuid4().hex}"
    late = F.when((F.col("scan_no") * 5 + F.col("camera_id").cast("bigint")) % 9 == 4, 3).otherwise(0)
    rows = O.with_orders(_timed(zone_scans(spark, sf))).withColumn("batch", F.least(F.floor(F.col("scan_no") / 4) + late, F.lit(7)).cast("int"))
    counts = M.BatchCounts(spark, f"{base}/counts")
    spark.streams.addListener(counts)
    try:
        R.run_available(O.zones_in_order(_delivered(spark, rows, 8, 1_000_000), PLAIN, "0 seconds"), counts=counts)
    finally:
        spark.streams.removeListener(counts)
    return M.read_counts(spark, f"{base}/counts").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_late").alias("n_late"))


@query("stream_episodes", f"""WITH RECURSIVE {LOG}, l AS (SELECT *, n_changed = 0 OR scan_no % 5 = 0 AS rearmed, n_hot >= 3 AS escalated,
  row_number() OVER (PARTITION BY zone ORDER BY scan_no) AS i FROM log),
r AS (SELECT zone, i, t_s, n_hot, alert, rearmed, alert AND NOT escalated AS inside, CAST(alert AND NOT escalated AS BIGINT) AS episode FROM l WHERE i = 1
  UNION ALL
  SELECT l.zone, l.i, l.t_s, l.n_hot, l.alert, l.rearmed, x.inside, r.episode + CAST(x.inside AND NOT (r.inside AND NOT r.rearmed) AS BIGINT)
  FROM r JOIN l ON l.zone = r.zone AND l.i = r.i + 1,
  LATERAL (SELECT (r.inside AND NOT r.rearmed) OR (l.alert AND NOT l.escalated) AS inside) x)
SELECT zone, episode, min(t_s) AS t_start, max(t_s) FILTER (rearmed) AS t_end, count(*) FILTER (alert) AS n_alerts, max(n_hot) AS max_hot
FROM r WHERE inside GROUP BY zone, episode""")
def stream_episodes(spark, sf):
    """alert_episodes over a stream: an episode stays open over micro-batches until a scan re-arms."""
    log = B.scan_log(spark, sf).select("zone", "scan_no", "t_s", "alert", "n_hot", (F.col("n_hot") >= 3).alias("escalated"),
                                       ((F.col("n_changed") == 0) | (F.col("scan_no") % 5 == 0)).alias("rearmed"), F.timestamp_seconds("t_s").alias("ts"))
    tick = log.agg((F.max("t_s") + 1e6).alias("end")).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema if f.name not in ("ts", "scan_no")],
                                                            F.lit(-1).cast("bigint").alias("scan_no"), F.timestamp_seconds("end").alias("ts"), F.lit(5).alias("batch"))
    ends = log.agg(F.min("t_s").alias("lo"), F.max("t_s").alias("hi")).first()
    width = (ends["hi"] - ends["lo"] + 1) / 5
    rows = log.withColumn("batch", F.floor((F.col("t_s") - ends["lo"]) / width).cast("int")).unionByName(tick)
    path = R.stage_batches(rows, "batch", list(range(6)))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return O.latest_episodes(R.run_available(O.episodes_in_order(stream, BY)), BY)
