"""Queries over detections and scores inside the zone scan, table functions, and calibration from sketches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from zonewatch.catalog.base import OBS, query
from zonewatch.catalog.more import GATE
from zonewatch.catalog.reports import BY
from zonewatch.catalog.scans import THR, zone_cells
from zonewatch.catalog.space import GRID, ITILES, _images
from zonewatch.functions.tables import register_tables
from zonewatch.operators import detect as DT
from zonewatch.operators import pixels as P
from zonewatch.operators import zone_scan as Z
from zonewatch.params import ScanParams
from zonewatch.plans import calibrate
from zonewatch.sinks import writers as W
from zonewatch.sources import bindings as B

SCAN = ["camera_id", "zone_id", "sig", "scan_no", "t_s"]
ALERTING = ScanParams(thr=THR, mode="change_only", dwell=2, n=1, m=1, alert_mode="cooldown", cooldown_s=0.0, min_hot=1, guard_frac=2.0,
                      clutter_on=False, verify_on=True, escalate_after=2)


@query("scan_to_alert_rows", f"""WITH RECURSIVE {GATE},
b AS (SELECT CAST(vec_id // 125 AS VARCHAR) AS camera_id, label, row_number() OVER (PARTITION BY vec_id // 125, label ORDER BY vec_id) AS scan_no, label % 5 * 32 AS x, label // 5 * 32 AS y,
  embedding[2] < 0.05 AS det, embedding[3] < 0.0 AS fine, embedding[5]::DOUBLE AS conf FROM embeddings),
h AS (SELECT r.camera_id, r.label, r.scan_no, b.det, b.fine, r.scan_no % 5 = 3 AS failed, row_number() OVER (PARTITION BY r.camera_id, r.label, r.scan_no % 5 = 3 ORDER BY r.scan_no) AS i
  FROM run r JOIN b USING (camera_id, label, scan_no) WHERE r.run >= 2),
j AS (
  SELECT camera_id, label, scan_no, i, det, NOT det AND false AS rescued, CASE WHEN det THEN 0 ELSE 1 END AS rejects FROM h WHERE NOT failed AND i = 1
  UNION ALL
  SELECT h.camera_id, h.label, h.scan_no, h.i, h.det, NOT h.det AND j.rejects >= 1 AND h.fine, CASE WHEN h.det OR (j.rejects >= 1 AND h.fine) THEN 0 ELSE j.rejects + 1 END
  FROM j JOIN h ON NOT h.failed AND h.camera_id=j.camera_id AND h.label=j.label AND h.i=j.i+1),
hot AS (SELECT camera_id, scan_no, label, rescued FROM j WHERE det OR rescued UNION ALL SELECT camera_id, scan_no, label, false FROM h WHERE failed),
a AS (SELECT camera_id, scan_no, count(*)::INTEGER AS n_hot, bool_or(rescued) AS closer FROM hot GROUP BY ALL),
seen AS (SELECT camera_id, scan_no, x+4.0::DOUBLE AS x1, y+4.0::DOUBLE AS y1, x+28.0::DOUBLE AS x2, y+28.0::DOUBLE AS y2, conf FROM b WHERE det AND scan_no % 5 <> 3
  UNION ALL SELECT b.camera_id, b.scan_no, x+8.0::DOUBLE, y+8.0::DOUBLE, x+24.0::DOUBLE, y+24.0::DOUBLE, conf/2 FROM b JOIN a USING (camera_id, scan_no) WHERE fine AND closer)
SELECT camera_id, scan_no, x1, y1, x2, y2, n_hot, round(conf, 3) AS det_conf FROM a JOIN seen USING (camera_id, scan_no)
UNION ALL SELECT camera_id, scan_no, min(label % 5 * 32)::DOUBLE, min(label // 5 * 32)::DOUBLE, max(label % 5 * 32 + 32)::DOUBLE, max(label // 5 * 32 + 32)::DOUBLE, any_value(n_hot), NULL
  FROM a JOIN hot USING (camera_id, scan_no) WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.camera_id=a.camera_id AND s.scan_no=a.scan_no) GROUP BY camera_id, scan_no""")
def scan_to_alert_rows(spark, sf):
    """Cells and detections -> zone scan -> rows of the alert sink. Boxes of the usual and of the closer look come through the
    scan with their confidence; in every fifth scan the detector fails and the hull of the hot cells stands in."""
    px, py = F.col("col") * 32, F.col("row") * 32
    corners = {"x1": px, "y1": py, "x2": px + 32, "y2": py + 32}
    cells = zone_cells(spark, sf).drop("sweep_hit").withColumns(corners)
    conf = (F.col("score") - 0.5) / 2
    looked = lambda flag, pad, share: cells.filter(flag).select(
        *SCAN, (px + pad).alias("x1"), (py + pad).alias("y1"), (px + 32 - pad).alias("x2"), (py + 32 - pad).alias("y2"), (conf / share).alias("conf"))
    boxes, fine = looked("det_hit", 4, 1), looked("fine_hit", 8, 2)
    failed = cells.filter("scan_no % 5 = 3").select(*SCAN)
    plain = cells.drop("det_hit", "fine_hit", "score")
    scans = DT.attach_detections(plain, SCAN, boxes.filter("scan_no % 5 <> 3"), fine, failed=failed)
    found = Z.scan_batch(scans, ALERTING)
    by = ["camera_id", "zone_id", "scan_no"]
    rows = W.alert_rows(found, W.result_boxes(found, by), W.result_hulls(found, plain, by), by)
    return rows.select("camera_id", "scan_no", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))],
                       F.col("extra.n_hot").alias("n_hot"), F.col("extra.det_conf").alias("det_conf"))


def brightness():
    """A scorer: mean brightness of a patch. A model would be loaded here, once per task."""
    return lambda patches: [float(np.mean(p)) / 255 for p in patches]


@query("patch_scores", """WITH f AS (SELECT CAST(vec_id // 125 AS VARCHAR) AS camera_id, vec_id % 125 AS scan_no,
   list_transform(embedding, lambda v: trunc(greatest(0.0, least(255.0, 128+400*v::DOUBLE)))) AS g FROM embeddings),
q AS (SELECT camera_id, scan_no, r, c, list_sum(list_transform(range(0,16), lambda i: g[(r*4 + i//4)*8 + c*4 + i%4 + 1]))/16/255 AS score
  FROM f, (VALUES (0),(1)) a(r), (VALUES (0),(1)) b(c))
SELECT camera_id, scan_no, count(*) FILTER (score >= 0.5 AND r*2 + c < 3)::INTEGER AS n_raw_hot, 1 AS n_dropped, round(max(score), 9) AS top FROM q GROUP BY ALL""")
def patch_scores(spark, sf):
    """Frames -> patches -> a scorer over patches -> classifier mode of the zone scan, which takes the first three cells."""
    quarter = spark.range(4).select((F.col("id").cast("int") / 2).cast("int").alias("row"), (F.col("id") % 2).cast("int").alias("col"))
    frames = B.frames(spark, sf)
    cells = frames.select("camera_id").distinct().join(F.broadcast(quarter), F.lit(True)).select(
        "camera_id", F.lit("z0").alias("zone_id"), F.lit("g").alias("sig"), "row", "col", (F.col("col") * 4).alias("x1"), (F.col("row") * 4).alias("y1"),
        (F.col("col") * 4 + 4).alias("x2"), (F.col("row") * 4 + 4).alias("y2"))
    scans = P.describe_frames(frames, cells, brightness)
    p = ScanParams(mode="classifier", change_on=False, litter_thr=0.5, max_score=3, clutter_on=False, verify_on=False)
    found = Z.scan_batch(scans, p).select("camera_id", "scan_no", "n_raw_hot", "n_dropped")
    top = scans.select("camera_id", "scan_no", F.round(F.array_max("score"), 9).alias("top"))
    return found.join(top, ["camera_id", "scan_no"])


@query("grid_table_function", f"WITH {GRID} SELECT * FROM grid")
def grid_table_function(spark, sf):
    register_tables(spark)
    B.zones(spark, sf).createOrReplaceTempView("zonewatch_zones")
    return spark.sql("SELECT * FROM build_grid(TABLE(zonewatch_zones), 64, 0.5)").drop("zone_id", "sig")


@query("tiles_table_function", f"WITH {ITILES} SELECT image, tile_no, x1, y1, x2, y2 FROM it")
def tiles_table_function(spark, sf):
    register_tables(spark)
    _images(spark, sf).createOrReplaceTempView("zonewatch_images")
    return spark.sql("SELECT image, tile_no, x1, y1, x2, y2 FROM image_tiles(TABLE(zonewatch_images), 320, 0.5)")


@query("noise_floor_sketch", f"""WITH {OBS}, s AS (SELECT zone, value/25.0::DOUBLE AS score, t_us // 3600000000 AS scan_no FROM obs WHERE NOT changed)
SELECT zone, count(*) AS n_scores, max(score) AS top, true AS p50_near, true AS p99_near, true AS p999_near, true AS scans_near FROM s GROUP BY zone""")
def noise_floor_sketch(spark, sf):
    """The noise floor from sketches per zone and day: what they merge to, and whether the ranks are right within 0.1 %."""
    day = F.floor(F.col("t_us") / 86_400_000_000).alias("day")
    clean = B.observations(spark, sf).filter("not changed").select("zone", day, (F.col("value") / 25.0).alias("score"),
                                                                   F.floor(F.col("t_us") / 3_600_000_000).alias("scan_no"))
    scores = calibrate.value_sketches(clean, ["zone", "day"], "score", "scan_no")
    shifts = calibrate.value_sketches(clean, ["zone", "day"], "score")
    floor = calibrate.noise_floor_sketch(scores, shifts, shifts, BY)
    top = calibrate.merged_quantiles(scores, BY, {"top": 1.0}).select("zone", "top")
    named = {"p50": .5, "p99": .99, "p999": .999}
    n = F.count(F.lit(1))
    share = lambda cond: F.count_if(cond) / n
    ranks = clean.join(floor, BY).groupBy("zone").agg(n.alias("n_scores"), *[
        ((share(F.col("score") < F.col(c)) <= p + 0.001) & (share(F.col("score") <= F.col(c)) >= p - 0.001)).alias(f"{c}_near") for c, p in named.items()],
        (F.abs(F.count_distinct("scan_no") - F.max("n_scans")) <= 0.05 * F.max("n_scans")).alias("scans_near"))
    return ranks.join(top, BY).select("zone", "n_scores", "top", *[f"{c}_near" for c in named], "scans_near")
