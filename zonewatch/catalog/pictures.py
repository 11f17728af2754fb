"""Queries over pixels, frames, detectors, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from zonewatch.catalog.base import BOXES, LOG, OBS, ZONES, inside_sql, query
from zonewatch.catalog.scans import PARAMS, zone_scans
from zonewatch.functions import geometry as G
from zonewatch.operators import detect as DT
from zonewatch.operators import grid as GR
from zonewatch.operators import pixels as P
from zonewatch.plans import calibrate
from zonewatch.session import materialize, shared_dir
from zonewatch.sinks import writers as W
from zonewatch.sources import bindings as B
from zonewatch.streaming import run as R
from zonewatch.streaming import scan as SS
from zonewatch.streaming import state as ST

BY, WIDTH, HEIGHT = ["zone"], 8, 24
KEYS = ["zone", "scan_no"]

PX = OBS + """, px AS (SELECT zone, CAST(t_us // 259200000000 AS INTEGER) AS scan_no, CAST((t_us // 3600000000) % 24 AS INTEGER) AS "row",
  CAST(user_id % 8 AS INTEGER) AS col, CAST(least(255, floor(max(value)*2)) AS INTEGER) AS gray FROM obs GROUP BY ALL),
fr AS (SELECT zone, scan_no, row_number() OVER (PARTITION BY zone ORDER BY scan_no) - 1 AS frame_no,
  count(*) OVER (PARTITION BY zone) AS n_frames FROM (SELECT DISTINCT zone, scan_no FROM px)),
bg AS (SELECT zone, "row", col, CAST(floor(quantile_cont(gray, 0.5)) AS INTEGER) AS ref FROM px JOIN fr USING (zone, scan_no)
  WHERE frame_no < 4 GROUP BY ALL),
mk AS (SELECT px.zone, px.scan_no, px."row", px.col FROM px JOIN bg ON bg.zone=px.zone AND bg."row"=px."row" AND bg.col=px.col
  JOIN (SELECT zone, scan_no, avg(gray) AS m FROM px GROUP BY ALL) a ON a.zone=px.zone AND a.scan_no=px.scan_no
  JOIN (SELECT zone, avg(ref) AS rm FROM bg GROUP BY ALL) r ON r.zone=px.zone WHERE abs((gray-m)-(ref-rm)) > 20)"""


def _mask(spark, sf):
    px = B.pictures(spark, sf)
    return P.diff_mask(px, P.median_background(px, BY, "scan_no", 4), BY, "scan_no", 20)


@query("median_background", f"WITH {PX} SELECT * FROM bg")
def median_background(spark, sf):
    return P.median_background(B.pictures(spark, sf), BY, "scan_no", 4)


@query("diff_mask", f"WITH {PX} SELECT * FROM mk")
def diff_mask(spark, sf):
    return _mask(spark, sf)


@query("mask_opening", f"""WITH {PX}, nb AS (SELECT m.zone, m.scan_no, m."row"+i AS "row", m.col+j AS col, count(*) AS n
   FROM mk m, (VALUES (-1),(0),(1)) a(i), (VALUES (-1),(0),(1)) b(j) GROUP BY ALL),
er AS (SELECT zone, scan_no, "row", col FROM nb WHERE "row" BETWEEN 0 AND 23 AND col BETWEEN 0 AND 7 AND
  n = (least("row"+1,23)-greatest("row"-1,0)+1)*(least(col+1,7)-greatest(col-1,0)+1)),
op AS (SELECT DISTINCT m.zone, m.scan_no, m."row"+i AS "row", m.col+j AS col FROM er m, (VALUES (-1),(0),(1)) a(i), (VALUES (-1),(0),(1)) b(j))
SELECT * FROM op WHERE "row" BETWEEN 0 AND 23 AND col BETWEEN 0 AND 7""")
def mask_opening(spark, sf):
    return P.opened(_mask(spark, sf), KEYS, WIDTH, HEIGHT)


@query("mask_dilation", f"""WITH {PX}, v AS (SELECT unnest(range(-3,4)) AS k) SELECT DISTINCT m.zone, m.scan_no,
  CAST(m."row"+a.k AS INTEGER) AS "row", CAST(m.col+b.k AS INTEGER) AS col FROM mk m, v a, v b
  WHERE m."row"+a.k BETWEEN 0 AND 23 AND m.col+b.k BETWEEN 0 AND 7""")
def mask_dilation(spark, sf):
    return P.dilate(_mask(spark, sf), KEYS, 7, WIDTH, HEIGHT)


@query("stay_mask", f"""WITH {PX}, t AS (SELECT zone, scan_no, least(greatest(5, n_frames // 5), n_frames) AS k FROM fr
   WHERE frame_no >= n_frames - least(greatest(5, n_frames // 5), n_frames))
SELECT zone, "row", col FROM mk JOIN t USING (zone, scan_no) GROUP BY ALL HAVING count(*) > 0.55 * max(k)""")
def stay_mask(spark, sf):
    px = B.pictures(spark, sf)
    return P.stay_mask(_mask(spark, sf), P.frame_rank(px, BY, "scan_no"), BY, "scan_no", 0.55)


@query("left_objects")
def left_objects(spark, sf):
    return P.find_events(B.pictures(spark, sf), BY, "scan_no", WIDTH, HEIGHT, warm=4, thr=20.0, min_area=1,
                         max_frac=1.0, hold=0.2)


SCENE, FRAMES = 32, 12
TASK_SCENES = 50  # scenes, of 12 288 pixels each, that a task is given
# what must come out of a scene follows from its object alone: opening keeps it if no side is under 3, dilation by 7 adds 3
# around, the gates are 120 pixels and 15 % of the frame, and it has to be there in the last five frames
OBJECTS = """o AS (SELECT s_suppkey AS camera_id, 2 + s_suppkey % 9 AS w, 2 + s_suppkey * 3 % 8 AS h, s_suppkey * 5 % 22 AS x, s_suppkey * 11 % 22 AS y,
  4 + s_suppkey % 6 AS f0, CASE WHEN s_suppkey % 7 = 0 THEN 9 ELSE 99 END AS f1 FROM supplier),
g AS (SELECT *, greatest(x-3,0) AS x1, greatest(y-3,0) AS y1, least(x+w+3,32) AS x2, least(y+h+3,32) AS y2 FROM o),
k AS (SELECT *, (x2-x1)*(y2-y1) AS area, w >= 3 AND h >= 3 AND f0 <= 7 AND f1 > 12 AND (x2-x1)*(y2-y1) BETWEEN 120 AND 0.15*32*32 AS found FROM g)"""


@query("left_object_events", f"""WITH {OBJECTS} SELECT camera_id, CASE WHEN found THEN area END AS area, CASE WHEN found THEN x1 END AS x1, CASE WHEN found THEN y1 END AS y1,
  CASE WHEN found THEN x2 END AS x2, CASE WHEN found THEN y2 END AS y2, CASE WHEN found THEN f0 END AS event_frame, CASE WHEN found THEN f0 / 2.5::DOUBLE END AS event_s FROM k""")
def left_object_events(spark, sf):
    """supplier -> a scene each of 12 frames with a texture, in which an object is put down and sometimes taken away;
    the operator's own gates decide which are events."""
    k, f, r, c = (F.col(n) for n in ("camera_id", "frame", "row", "col"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cameras = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("camera_id"))
    # scenes are dealt out before they become pixels, so that no pixel is shuffled or written
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cameras.count() // TASK_SCENES + 1)
    px = (cameras.repartition(n, "camera_id").withColumn("frame", upto(FRAMES))
          .withColumn("row", upto(SCENE)).withColumn("col", upto(SCENE)))
    w, h, x, y, f0 = 2 + k % 9, 2 + k * 3 % 8, k * 5 % 22, k * 11 % 22, 4 + k % 6
    there = (f >= f0) & ((k % 7 != 0) | (f < 9)) & (c >= x) & (c < x + w) & (r >= y) & (r < y + h)
    px = px.withColumn("gray", (60 + (k * 7 + r * 3 + c * 5) % 20 + F.when(there, 90).otherwise(0)).cast("int"))
    out = P.find_events(px, ["camera_id"], "frame", SCENE, SCENE, warm=4, fps=2.5, per_task=TASK_SCENES)
    return out.select("camera_id", *[F.col(n).cast("bigint").alias(n) for n in ("area", "x1", "y1", "x2", "y2", "event_frame")], "event_s")


@query("difference_objects")
def difference_objects(spark, sf):
    px = B.pictures(spark, sf)
    return P.diff_objects(px, P.median_background(px, BY, "scan_no", 4), KEYS, BY, WIDTH, HEIGHT,
                          thr=20, min_area=9, min_side=3, left=0.0, shrink=1)


@query("color_count", f"""WITH {PX} SELECT zone, scan_no, count(*) FILTER (gray > 120 AND col < 5) AS n_pixels,
  count(*) FILTER (gray > 120 AND col < 5) >= 20 AS hit FROM px GROUP BY ALL""")
def color_count(spark, sf):
    return P.color_count(B.pictures(spark, sf), KEYS, (F.col("gray") > 120) & (F.col("col") < 5), 20)


@query("frame_descriptors", """WITH f AS (SELECT CAST(vec_id // 125 AS VARCHAR) AS camera_id, vec_id % 125 AS scan_no,
   list_transform(embedding, lambda v: trunc(greatest(0.0, least(255.0, 128+400*v::DOUBLE)))) AS g FROM embeddings),
d AS (SELECT camera_id, scan_no, list_transform(g, lambda v: v - list_sum(g)/64) AS d FROM f)
SELECT camera_id, scan_no, 1 AS n_cells, d[1] AS first, d[64] AS last, list_sum(list_transform(d, lambda v: abs(v))) AS total FROM d""")
def frame_descriptors(spark, sf):
    f = B.frames(spark, sf)
    cells = f.select("camera_id").distinct().select(
        "camera_id", F.lit("z0").alias("zone_id"), F.lit("g").alias("sig"), F.lit(0).alias("row"), F.lit(0).alias("col"),
        F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(8).alias("x2"), F.lit(8).alias("y2"))
    d = P.describe_frames(f, cells)
    total = F.aggregate("desc", F.lit(0.0), lambda a, v: a + F.abs(v.cast("double")))
    return d.select("camera_id", "scan_no", "n_cells", F.element_at("desc", 1).cast("double").alias("first"),
                    F.element_at("desc", 64).cast("double").alias("last"), total.alias("total"))


@query("scene_shift")
def scene_shift(spark, sf):
    return P.scene_shift(P.thumbs(B.frames(spark, sf), 8), ["camera_id"], "scan_no")


@query("anchor_drift")
def anchor_drift(spark, sf):
    t = P.thumbs(B.frames(spark, sf), 8)
    return P.anchor_drift(t, t.filter("scan_no = 0"), ["camera_id"], "scan_no", 1.0)


# --- detectors and sinks --------------------------------------------------------------

LABELS = ["person", "bag", "car", "bottle"]


def _table_detections(spark, sf):
    x1, y1 = F.col("l_partkey") * 37 % 500, F.col("l_orderkey") * 53 % 400
    return B.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("camera_id"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
        (x1 + F.col("l_quantity") * 2).cast("double").alias("x2"), (y1 + F.col("l_quantity") * 2).cast("double").alias("y2"),
        (F.col("l_linenumber") / 10.0).alias("score"),
        F.element_at(F.array(*[F.lit(v) for v in LABELS]), (F.col("l_partkey") % 4 + 1).cast("int")).alias("label"))


TDET = """td AS (SELECT l_suppkey AS camera_id, CAST(l_partkey*37 % 500 AS DOUBLE) AS x1, CAST(l_orderkey*53 % 400 AS DOUBLE) AS y1,
  CAST(l_partkey*37 % 500 + l_quantity*2 AS DOUBLE) AS x2, CAST(l_orderkey*53 % 400 + l_quantity*2 AS DOUBLE) AS y2,
  l_linenumber/10.0::DOUBLE AS score, ['person','bag','car','bottle'][l_partkey % 4 + 1] AS label FROM lineitem)"""


@query("occluder_boxes", f"""WITH {TDET} SELECT camera_id, label, count(*) AS n FROM td WHERE label IN ('person','car') AND score >= 0.35 GROUP BY ALL""")
def occluder_boxes(spark, sf):
    o = DT.occluders(_table_detections(spark, sf))
    return o.groupBy("camera_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query("detect_in_zone", f"""WITH RECURSIVE {ZONES}, {TDET}, inz AS (SELECT DISTINCT td.camera_id, x1, y1, x2, y2, score FROM td JOIN zbox USING (camera_id)
   WHERE score >= 0.2 AND (x1+x2)/2 BETWEEN bx1 AND bx2 AND (y1+y2)/2 BETWEEN by1 AND by2 AND {inside_sql('((x1+x2)/2.0::DOUBLE)', 'y2')}),
b AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY -score, x1, y1, x2, y2) AS rn FROM inz),
run AS (SELECT camera_id, rn, x1, y1, x2, y2, score, true AS keep, [{{'x1':x1,'y1':y1,'x2':x2,'y2':y2}}] AS kept FROM b WHERE rn = 1
  UNION ALL
  SELECT n.camera_id, n.rn, n.x1, n.y1, n.x2, n.y2, n.score, z.ok, CASE WHEN z.ok THEN list_append(r.kept, {{'x1':n.x1,'y1':n.y1,'x2':n.x2,'y2':n.y2}}) ELSE r.kept END
  FROM run r JOIN b n ON n.camera_id = r.camera_id AND n.rn = r.rn + 1,
  LATERAL (SELECT len(list_filter(r.kept, lambda k: greatest(least(k.x2,n.x2)-greatest(k.x1,n.x1),0)
     *greatest(least(k.y2,n.y2)-greatest(k.y1,n.y1),0) / ((k.x2-k.x1)*(k.y2-k.y1)+(n.x2-n.x1)*(n.y2-n.y1)
     -greatest(least(k.x2,n.x2)-greatest(k.x1,n.x1),0)*greatest(least(k.y2,n.y2)-greatest(k.y1,n.y1),0)+1e-9) > 0.5)) = 0 AS ok) z)
SELECT camera_id, x1, y1, x2, y2, score FROM run WHERE keep""")
def detect_in_zone(spark, sf):
    zones = GR.zone_layout(B.zones(spark, sf)).select("camera_id", "poly", "frame_w", "frame_h")
    det = DT.TableDetector(_table_detections(spark, sf).drop("label").distinct().withColumn("label", F.lit("x")), 0.2)
    return DT.detect_in_zone(zones, det, ["camera_id"], 160, 0.5).drop("label")


def _hot_cells(spark, sf):
    """Grid cells under a confident bottle."""
    bottles = _table_detections(spark, sf).filter("label = 'bottle' and score >= 0.7")
    cells = GR.verified_cells(GR.build_grid(B.zones(spark, sf)), bottles, ["camera_id"])
    return cells.withColumns({"frame_w": F.lit(640), "frame_h": F.lit(480)})


@query("alert_sink_rows", f"""WITH {LOG}, hh AS (SELECT zone, t_us // 3600000000 AS scan_no, min(col)*32 AS x1, min("row")*32 AS y1, max(col)*32+64 AS x2, max("row")*32+64 AS y2
   FROM obs WHERE value >= 100 GROUP BY ALL),
bx AS (SELECT zone, t_us // 3600000000 AS scan_no, col*32 AS x1, "row"*32 AS y1, col*32+64 AS x2, "row"*32+64 AS y2, value/1000.0::DOUBLE AS conf FROM obs WHERE value >= 200),
al AS (SELECT * FROM log WHERE alert)
SELECT zone, scan_no, x1, y1, x2, y2, n_hot, round(conf,3) AS det_conf FROM al JOIN bx USING (zone, scan_no)
UNION ALL SELECT zone, scan_no, x1, y1, x2, y2, n_hot, NULL FROM al JOIN hh USING (zone, scan_no)
 WHERE NOT EXISTS (SELECT 1 FROM bx WHERE bx.zone=al.zone AND bx.scan_no=al.scan_no)""")
def alert_sink_rows(spark, sf):
    o = B.observations(spark, sf).withColumn("scan_no", F.floor(F.col("t_us") / 3_600_000_000))
    px = G.Box(F.col("col") * 32, F.col("row") * 32, F.col("col") * 32 + 64, F.col("row") * 32 + 64)
    boxes = o.filter("value >= 200").select(*KEYS, *[c.cast("double").alias(n) for c, n in zip(px, ("x1", "y1", "x2", "y2"))],
                                            (F.col("value") / 1000.0).alias("conf"))
    hulls = o.filter("value >= 100").groupBy(*KEYS).agg(
        F.min(px.x1).alias("x1"), F.min(px.y1).alias("y1"), F.max(px.x2).alias("x2"), F.max(px.y2).alias("y2"))
    scans = B.scan_log(spark, sf).withColumns({"n_fresh": F.col("n_hot"), "escalated": F.lit(False), "n_sweep_hot": F.lit(0)})
    rows = W.alert_rows(scans, boxes, hulls, KEYS)
    return rows.select(*KEYS, *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))],
                       F.col("extra.n_hot").alias("n_hot"), F.col("extra.det_conf").alias("det_conf"))


@query("hard_negatives", f"""WITH {BOXES}, c AS (SELECT image, score AS conf, CAST(greatest(0,trunc(x1)-16) AS INTEGER) AS cx1, CAST(greatest(0,trunc(y1)-16) AS INTEGER) AS cy1,
  CAST(least(420,trunc(x2)+16) AS INTEGER) AS cx2, CAST(least(210,trunc(y2)+16) AS INTEGER) AS cy2 FROM det)
SELECT image, conf, cx1, cy1, cx2, cy2 FROM c WHERE least(cx2-cx1, cy2-cy1) >= 24""")
def hard_negatives(spark, sf):
    d = B.detections(spark, sf).withColumnRenamed("score", "conf").withColumns({"frame_w": F.lit(420), "frame_h": F.lit(210)})
    return W.hard_negatives(d).select("image", "conf", "cx1", "cy1", "cx2", "cy2")


@query("calibration_text", f"""WITH {OBS}, s AS (SELECT zone, value/25.0::DOUBLE AS score FROM obs WHERE NOT changed),
q AS (SELECT zone, quantile_cont(score,.999) AS p, quantile_cont(score,.99) AS s FROM s GROUP BY zone)
SELECT zone, printf('change:\n  thr: %.1f\nstabilize:\n  min_px: %.1f', least(greatest(1.5*p,4.0),10.0), least(greatest(1.5*s,2.0),6.0)) AS value FROM q""")
def calibration_text(spark, sf):
    o = B.observations(spark, sf)
    clean = o.filter("not changed")
    s = clean.select("zone", (F.col("value") / 25.0).alias("score"), F.floor(F.col("t_us") / 3_600_000_000).alias("scan_no"))
    px = clean.select("zone", (F.col("value") / 25.0).alias("px"))
    return W.calibration_text(calibrate.noise_floor(s, px, px, BY), BY)


# --- streams --------------------------------------------------------------------------

def _scan_stream(spark, sf):
    from zonewatch.operators.zone_scan import complete_scans
    from zonewatch.sources.readers import read_scans_stream
    path = R.stage_input(complete_scans(zone_scans(spark, sf)), 3, ["scan_no", "camera_id"], ["camera_id"])
    return read_scans_stream(spark, path)


@query("zone_fsm_stream")
def zone_fsm_stream(spark, sf):
    return R.run_available(SS.scan_stream(_scan_stream(spark, sf), PARAMS))


@query("zone_fsm_resumed")
def zone_fsm_resumed(spark, sf):
    """Second half of the scans, started from the saved state of the first half."""
    from zonewatch.operators.zone_scan import complete_scans
    from zonewatch.sources.readers import read_scans_stream
    scans = zone_scans(spark, sf)
    half = scans.groupBy("camera_id").agg(F.floor(F.max("scan_no") / 2).alias("half"))
    scans = scans.join(half, "camera_id")
    path = f"{shared_dir(spark).rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    ST.save_state(ST.final_states(scans.filter("scan_no <= half").drop("half"), PARAMS), path)
    late = complete_scans(scans.filter("scan_no > half").drop("half"))
    stream = read_scans_stream(spark, R.stage_input(late, 2, ["scan_no", "camera_id"], ["camera_id"]))
    return R.run_available(SS.scan_stream(stream, PARAMS, initial=ST.load_state(spark, path)))


def _log_stream(spark, sf):
    log = B.scan_log(spark, sf).withColumn("ts", F.timestamp_seconds("t_s"))
    path = R.stage_input(log, 4, ["t_s", "zone"], ["zone"])
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_time_bins", f"""WITH {LOG} SELECT zone, CAST(floor(t_s/21600) AS BIGINT) AS bin, count(*) AS n_scans,
  count(*) FILTER (n_hot > 0) AS n_with_hot, count(*) FILTER (alert) AS n_alerts, avg(n_changed) AS mean_changed FROM log
  GROUP BY zone, floor(t_s/21600) HAVING (floor(t_s/21600)+1)*21600 <= (SELECT max(t_s) - 3600 FROM log)""")
def stream_time_bins(spark, sf):
    out = R.run_available(SS.windowed_report(_log_stream(spark, sf), "ts", BY, 360))
    return out.select("zone", F.floor(F.unix_seconds("start") / 21600).alias("bin"), "n_scans", "n_with_hot", "n_alerts",
                      "mean_changed")


@query("stream_alert_sessions", f"""WITH {LOG}, a AS (SELECT zone, t_s, n_hot, CASE WHEN t_s <= lag(t_s) OVER (PARTITION BY zone ORDER BY t_s) + 10800 THEN 0 ELSE 1 END AS new
   FROM log WHERE alert), s AS (SELECT *, sum(new) OVER (PARTITION BY zone ORDER BY t_s) AS k FROM a)
SELECT zone, CAST(min(t_s) AS BIGINT) AS t_start, count(*) AS n_alerts, max(n_hot) AS max_hot FROM s GROUP BY zone, k
HAVING max(t_s) + 10800 <= (SELECT max(t_s) - 3600 FROM log WHERE alert)""")
def stream_alert_sessions(spark, sf):
    out = R.run_available(SS.alert_sessions(_log_stream(spark, sf), "ts", BY, "3 hours"))
    return out.select("zone", F.unix_seconds("start").alias("t_start"), "n_alerts", "max_hot")


@query("stream_latest_status", f"""WITH {LOG} SELECT zone, max(scan_no) AS scan_no, arg_max(n_hot, scan_no) AS n_hot FROM log GROUP BY zone""")
def stream_latest_status(spark, sf):
    base = f"{shared_dir(spark).rstrip('/')}/status-{uuid.uuid4().hex}"
    log = _log_stream(spark, sf).select("zone", "scan_no", "n_hot", "t_s")
    q = (log.writeStream.foreachBatch(W.upsert_status(base, BY)).option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    return spark.read.parquet(f"{base}/v{last % 2}").drop("t_s")
