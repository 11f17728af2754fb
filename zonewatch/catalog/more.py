"""Further queries: compositions of operators already checked on their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonewatch.catalog.base import BOXES, LOG, OBS, center_sql, query, touches_sql
from zonewatch.catalog.pictures import TDET, _hot_cells, _scan_stream, _table_detections
from zonewatch.catalog.quality import FILES, _files
from zonewatch.catalog.scans import SCORE, THR, zone_scans
from zonewatch.catalog.space import GRID
from zonewatch.functions import keys as K
from zonewatch.operators import boxes as BX
from zonewatch.operators import detect as DT
from zonewatch.operators import gates
from zonewatch.operators import sampling as S
from zonewatch.operators import tiling as TL
from zonewatch.operators import zone_scan as Z
from zonewatch.operators.grid import verified_cells
from zonewatch.params import ScanParams
from zonewatch.plans import dataset as D
from zonewatch.plans import evaluation as E
from zonewatch.plans import runlog
from zonewatch.sources import bindings as B
from zonewatch.streaming import run as R
from zonewatch.streaming import scan as SS
from zonewatch.streaming import state as ST

CORNERS = ["x1", "y1", "x2", "y2"]

HOT = GRID + f""", {TDET}, hot AS (SELECT * FROM grid g WHERE EXISTS (SELECT 1 FROM td WHERE td.camera_id=g.camera_id AND td.label='bottle' AND td.score >= 0.7
  AND {touches_sql('g', 'td')})),
td2 AS (SELECT * FROM td WHERE score >= 0.2)"""

HCOMP = HOT + """, reach AS (
  SELECT camera_id, "row" AS r0, col AS c0, "row", col FROM hot
  UNION
  SELECT p.camera_id, p.r0, p.c0, d."row", d.col FROM reach p JOIN hot d ON d.camera_id=p.camera_id
    AND abs(d."row"-p."row") <= 1 AND abs(d.col-p.col) <= 1),
cm AS (SELECT camera_id, "row", col, min((r0, c0)) AS low FROM reach GROUP BY ALL),
cl AS (SELECT camera_id, low, count(*) AS n, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2
  FROM cm JOIN hot USING (camera_id, "row", col) GROUP BY ALL),
tp AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY n DESC, low) AS rn FROM cl),
ar AS (SELECT camera_id, greatest(0,x1-48) AS ax1, greatest(0,y1-48) AS ay1, least(640,x2+48) AS ax2, least(480,y2+48) AS ay2,
   least(320, greatest(160, x2-x1+96, y2-y1+96)) AS side, (x1+x2)/2.0 AS cx, (y1+y2)/2.0 AS cy FROM tp),
sq AS (SELECT *, trunc(greatest(0, least(640-side, cx-side/2.0))) AS rx1, trunc(greatest(0, least(480-side, cy-side/2.0))) AS ry1 FROM ar)"""

CX, CY = "(d.x1+d.x2)/2", "(d.y1+d.y2)/2"
CELLS_HIT = f"""SELECT DISTINCT h.camera_id, h."row", h.col FROM {{cells}} h JOIN seen d ON d.camera_id=h.camera_id WHERE {touches_sql('h', 'd')}"""


def _covered(side: int) -> str:
    """The detection's centre lies in some tile of the cluster's cover."""
    return (f"{CX} BETWEEN s.ax1 AND greatest(s.ax2, least(640, s.ax1+{side})) AND "
            f"{CY} BETWEEN s.ay1 AND greatest(s.ay2, least(480, s.ay1+{side}))")


@query("verify_clusters", f"""WITH RECURSIVE {HCOMP}, seen AS (SELECT DISTINCT d.* FROM td2 d JOIN sq s USING (camera_id)
  WHERE ({CX} BETWEEN s.rx1 AND least(640, s.rx1+s.side) AND {CY} BETWEEN s.ry1 AND least(480, s.ry1+s.side)) OR ({_covered(160)}))
{CELLS_HIT.format(cells='hot')}""")
def verify_clusters(spark, sf):
    det = DT.TableDetector(_table_detections(spark, sf), 0.2)
    return DT.verify(_hot_cells(spark, sf), det, ["camera_id"], extra_scales=[0.5]).cells.select("camera_id", "row", "col")


@query("verify_fine", f"""WITH RECURSIVE {HCOMP}, seen AS (SELECT DISTINCT d.* FROM td2 d JOIN sq s USING (camera_id) WHERE {_covered(128)})
{CELLS_HIT.format(cells='hot')}""")
def verify_fine(spark, sf):
    det = DT.TableDetector(_table_detections(spark, sf), 0.2)
    return DT.verify_fine(_hot_cells(spark, sf), det, ["camera_id"])[0].select("camera_id", "row", "col")


@query("verify_sweep", f"""WITH {HOT}, ar AS (SELECT camera_id, greatest(0,min(x1)-48) AS ax1, greatest(0,min(y1)-48) AS ay1,
   least(640,max(x2)+48) AS ax2, least(480,max(y2)+48) AS ay2 FROM grid GROUP BY camera_id),
seen AS (SELECT DISTINCT d.* FROM td2 d JOIN ar s USING (camera_id) WHERE {_covered(128)})
{CELLS_HIT.format(cells='grid')}""")
def verify_sweep(spark, sf):
    from zonewatch.operators.grid import build_grid
    det = DT.TableDetector(_table_detections(spark, sf), 0.2)
    cells = build_grid(B.zones(spark, sf)).withColumns({"frame_w": F.lit(640), "frame_h": F.lit(480)})
    return DT.sweep_verify(cells, det, ["camera_id"])[0].select("camera_id", "row", "col")


@query("on_person_counts", f"""WITH {HOT}, kp AS (SELECT DISTINCT h.camera_id, h."row", h.col FROM hot h JOIN td2 d USING (camera_id) WHERE d.label='bag' AND {touches_sql('h', 'd')}),
f AS (SELECT h.*, EXISTS (SELECT 1 FROM td d WHERE d.camera_id=h.camera_id AND d.label='person' AND d.score >= 0.35 AND {center_sql('h', 'd')}) AS on_p,
  EXISTS (SELECT 1 FROM kp WHERE kp.camera_id=h.camera_id AND kp."row"=h."row" AND kp.col=h.col) AS kept FROM hot h)
SELECT camera_id, count(*) FILTER (on_p) AS n_on, count(*) FILTER (NOT on_p) AS n_elsewhere,
  count(*) FILTER (on_p) > 0 AND count(*) FILTER (on_p AND kept) = 0 AS all_vetoed FROM f GROUP BY camera_id""")
def on_person_counts(spark, sf):
    hot, det = _hot_cells(spark, sf), _table_detections(spark, sf)
    kept = verified_cells(hot, det.filter("label = 'bag' and score >= 0.2"), ["camera_id"])
    return E.on_person_counts(hot, DT.occluders(det, ["person"]), kept, ["camera_id"])


@query("alerts_on_target", f"""WITH {HOT}, ev AS (SELECT camera_id, avg(x1)-60 AS x1, avg(y1)-60 AS y1, avg(x1)+60 AS x2, avg(y1)+60 AS y2 FROM td GROUP BY camera_id)
SELECT h.camera_id, min(h."row") AS first_on_target FROM hot h JOIN ev e USING (camera_id) WHERE {touches_sql('h', 'e')} GROUP BY h.camera_id""")
def alerts_on_target(spark, sf):
    mid = {c: F.avg(c) for c in ("x1", "y1")}
    ev = _table_detections(spark, sf).groupBy("camera_id").agg(
        (mid["x1"] - 60).alias("x1"), (mid["y1"] - 60).alias("y1"),
        (mid["x1"] + 60).alias("x2"), (mid["y1"] + 60).alias("y2"))
    return E.alerts_on_target(_hot_cells(spark, sf).withColumn("scan_no", F.col("row")), ev, ["camera_id"])


SIDE = "greatest(x2-x1, y2-y1)"


@query("recall_by_target_px", f"""WITH {BOXES}, b AS (SELECT g.*, g.image % 3 AS ds, px, px/{SIDE} AS s,
  EXISTS (SELECT 1 FROM det d WHERE d.image=g.image AND {center_sql('d', 'g')}) AS hit FROM gt g, (VALUES (20.0::DOUBLE),(45.0::DOUBLE),(90.0::DOUBLE)) v(px)),
w AS (SELECT *, round_even(least(greatest(0,(x1+x2)/2-640/s/2), 2000-640/s),0) AS wx, round_even(least(greatest(0,(y1+y2)/2-480/s/2), 1500-480/s),0) AS wy FROM b)
SELECT ds, px, count(*) AS n_gt, count(*) FILTER (hit) AS n_hit FROM w WHERE 640/s <= 2000 AND 480/s <= 1500 AND (x1-wx)*s >= 0 AND (y1-wy)*s >= 0
  AND (x2-wx)*s <= 640 AND (y2-wy)*s <= 480 GROUP BY ds, px""")
def recall_by_target_px(spark, sf):
    gt = B.truth_boxes(spark, sf)
    sized = S.sweep(gt.withColumns({"width": F.lit(2000.0), "height": F.lit(1500.0), "ds": F.col("image") % 3}),
                    [{"px": 20.0}, {"px": 45.0}, {"px": 90.0}])
    hits = BX.matched_gt(gt, B.detections(spark, sf), ["image"], CORNERS)
    return E.recall_by_target(TL.target_window(sized, F.col("px")), hits, ["image", *CORNERS], ["ds"])


# the change gate of every cell, guard off, hidden scans left out
GATE = f"""c AS (SELECT CAST(vec_id // 125 AS VARCHAR) AS camera_id, label, row_number() OVER (PARTITION BY vec_id // 125, label ORDER BY vec_id) AS scan_no,
   list_transform(embedding, lambda v: v::DOUBLE) AS d, embedding[1] < 0.25 AS visible FROM embeddings),
q AS (SELECT *, row_number() OVER (PARTITION BY camera_id, label ORDER BY scan_no) AS rn FROM c WHERE visible),
run AS (
  SELECT camera_id, label, scan_no, rn, d AS ref, true AS first, false AS changed, CAST(0 AS BIGINT) AS run FROM q WHERE rn = 1
  UNION ALL
  SELECT q.camera_id, q.label, q.scan_no, q.rn, CASE WHEN x.s >= {THR} THEN run.ref
      ELSE list_transform(range(1,65), lambda i: 0.95::DOUBLE*run.ref[i] + 0.05::DOUBLE*q.d[i]) END, false,
    x.s >= {THR}, CASE WHEN x.s >= {THR} THEN run.run + 1 ELSE 0 END
  FROM run JOIN q ON q.camera_id=run.camera_id AND q.label=run.label AND q.rn=run.rn+1, LATERAL (SELECT {SCORE.format(a='q.d', b='run.ref')} AS s) x)"""
PLAIN = ScanParams(thr=THR, mode="change_only", dwell=2, guard_frac=2.0, clutter_on=False)


@query("zone_change_counts", f"""WITH RECURSIVE {GATE},
n AS (SELECT camera_id, scan_no, count(*) AS n_cells, count(*) FILTER (NOT visible) AS n_occluded FROM c GROUP BY ALL)
SELECT n.camera_id, n.scan_no, n.n_cells::INTEGER AS n_cells, n.n_occluded::INTEGER AS n_occluded, count(*) FILTER (first OR changed)::INTEGER AS n_changed,
  count(*) FILTER (run >= 2)::INTEGER AS n_hot FROM n LEFT JOIN run USING (camera_id, scan_no) GROUP BY ALL""")
def zone_change_counts(spark, sf):
    out = Z.scan_batch(zone_scans(spark, sf), PLAIN)
    return out.select("camera_id", "scan_no", "n_cells", "n_occluded", "n_changed", "n_hot")


@query("zone_reference_state", f"""WITH RECURSIVE {GATE}, f AS (SELECT camera_id, label, arg_max(ref, rn) AS ref FROM run GROUP BY ALL)
SELECT camera_id, CAST(label // 5 AS INTEGER) AS "row", CAST(label % 5 AS INTEGER) AS col, ref[1] AS first, ref[64] AS last, list_sum(ref) AS total FROM f""")
def zone_reference_state(spark, sf):
    ref = ST.unpack_reference(ST.final_states(zone_scans(spark, sf), PLAIN))
    return ref.select("camera_id", "row", "col", F.element_at("desc", 1).alias("first"), F.element_at("desc", 64).alias("last"),
                      F.aggregate("desc", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("stream_change_counts", f"""WITH RECURSIVE {GATE},
n AS (SELECT camera_id, scan_no, count(*) AS n_cells, count(*) FILTER (NOT visible) AS n_occluded FROM c GROUP BY ALL)
SELECT n.camera_id, n.scan_no, n.n_occluded::INTEGER AS n_occluded, count(*) FILTER (first OR changed)::INTEGER AS n_changed,
  count(*) FILTER (run >= 2)::INTEGER AS n_hot FROM n LEFT JOIN run USING (camera_id, scan_no) GROUP BY ALL""")
def stream_change_counts(spark, sf):
    """The streaming form of zone_change_counts, over several micro-batches."""
    out = R.run_available(SS.scan_stream(_scan_stream(spark, sf), PLAIN))
    return out.select("camera_id", "scan_no", "n_occluded", "n_changed", "n_hot")


@query("control_orders", f"""WITH {LOG}, e AS (SELECT zone, t_us, CAST(t_us AS DOUBLE)/1000000.0::DOUBLE AS t, event_id FROM obs WHERE value >= 300),
p AS (SELECT e.zone, e.t, e.event_id, s.scan_no FROM e ASOF JOIN log s ON e.zone=s.zone AND e.t <= s.t_s)
SELECT zone, scan_no, arg_max('reset_' || event_id, t) AS control FROM p GROUP BY ALL""")
def control_orders(spark, sf):
    scans = B.scan_log(spark, sf).withColumn("control", F.lit(None).cast("string"))
    orders = B.observations(spark, sf).filter("value >= 300").select(
        "zone", (F.col("t_us").cast("double") / 1_000_000.0).alias("t_s"),
        F.concat(F.lit("reset_"), F.col("event_id").cast("string")).alias("order"))
    return Z.with_control(scans, orders, ["zone"]).filter("control is not null").select("zone", "scan_no", "control")


@query("alert_episodes", f"""WITH RECURSIVE {LOG}, l AS (SELECT *, n_changed = 0 OR scan_no % 5 = 0 AS rearmed, n_hot >= 3 AS escalated,
  row_number() OVER (PARTITION BY zone ORDER BY scan_no) AS i FROM log),
r AS (SELECT zone, i, t_s, n_hot, alert, rearmed, alert AND NOT escalated AS inside, CAST(alert AND NOT escalated AS BIGINT) AS episode FROM l WHERE i = 1
  UNION ALL
  SELECT l.zone, l.i, l.t_s, l.n_hot, l.alert, l.rearmed, x.inside, r.episode + CAST(x.inside AND NOT (r.inside AND NOT r.rearmed) AS BIGINT)
  FROM r JOIN l ON l.zone = r.zone AND l.i = r.i + 1,
  LATERAL (SELECT (r.inside AND NOT r.rearmed) OR (l.alert AND NOT l.escalated) AS inside) x)
SELECT zone, episode, min(t_s) AS t_start, max(t_s) FILTER (rearmed) AS t_end, count(*) FILTER (alert) AS n_alerts, max(n_hot) AS max_hot
FROM r WHERE inside GROUP BY zone, episode""")
def alert_episodes(spark, sf):
    log = B.scan_log(spark, sf).withColumns({"rearmed": (F.col("n_changed") == 0) | (F.col("scan_no") % 5 == 0), "escalated": F.col("n_hot") >= 3})
    return runlog.alert_sessions(log, ["zone"], ["scan_no"])


@query("union_sources", """SELECT source, count(*) AS n, count(o) AS n_other FROM (SELECT 'docs' AS source, doc_id AS id, NULL AS o FROM documents
  UNION ALL SELECT 'pages', page_id, url FROM pages) GROUP BY source""")
def union_sources(spark, sf):
    u = D.union_sources({"docs": B.table(spark, sf, "documents").select(F.col("doc_id").alias("id")),
                         "pages": B.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("o"))})
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("o").alias("n_other"))


@query("tile_splits", f"""WITH {FILES}, t AS (SELECT image_id, source, source || '_' || image_id || '_t' || k AS name FROM files, (VALUES (0),(1)) v(k))
SELECT s.split, count(*) AS n FROM t JOIN splits s ON s.image_id = CAST(regexp_extract(t.name, '^([A-Za-z]+)_(.+?)_(?:t\\d+|n\\d+|full)$', 2) AS BIGINT) GROUP BY ALL""")
def tile_splits(spark, sf):
    tiles = (B.files(spark, sf).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
             .withColumn("name", TL.tile_name(F.col("source"), F.col("image_id"), "t", F.col("k"))))
    parsed = tiles.select(K.tile_source(F.col("name")).alias("source"), K.tile_image(F.col("name")).cast("bigint").alias("image_id"))
    joined = D.tile_splits(parsed, _files(spark, sf))
    clip = K.clip_key(F.col("source"), F.col("file_name"))
    return joined.groupBy(K.split_of(clip).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("source_quartiles", f"""WITH {OBS}, s AS (SELECT zone, value, row_number() OVER (PARTITION BY zone ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY zone) AS n FROM obs)
SELECT zone, max(n) AS n, max(value) FILTER (i = n//2) AS upper_median, max(value) FILTER (i = n-1) AS top FROM s GROUP BY zone""")
def source_quartiles(spark, sf):
    from zonewatch.operators.ordered import indexed_values
    n = F.col("n")
    return indexed_values(B.observations(spark, sf), ["zone"], "value", {"upper_median": F.floor(n / 2), "top": n - 1})


@query("visibility_runs", f"""WITH {OBS}, g AS (SELECT zone, user_id, event_id, t_us, changed, row_number() OVER (PARTITION BY zone, user_id ORDER BY t_us, event_id)
   - row_number() OVER (PARTITION BY zone, user_id, changed ORDER BY t_us, event_id) AS k FROM obs),
r AS (SELECT zone, user_id, count(*) AS n FROM g WHERE changed GROUP BY zone, user_id, k)
SELECT zone, max(n) AS longest, count(*) AS n_stretches FROM r GROUP BY zone""")
def visibility_runs(spark, sf):
    d = gates.dwell(B.observations(spark, sf), F.col("changed"), ["zone", "user_id"], ["t_us", "event_id"])
    return d.groupBy("zone").agg(F.max("run").alias("longest"), F.count_if(F.col("run") == 1).alias("n_stretches"))
