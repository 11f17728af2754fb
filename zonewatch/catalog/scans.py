"""Queries over descriptors, the change gate and the zone scan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from zonewatch.catalog.base import query
from zonewatch.functions import descriptors as DS
from zonewatch.operators import zone_scan as Z
from zonewatch.operators.ordered import arrange
from zonewatch.params import ScanParams
from zonewatch.sources import bindings as B
from zonewatch.streaming import state as ST

THR = 0.30
SCORE = ("list_sum(list_sort(list_transform(range(1,65), lambda i: abs({a}[i]::DOUBLE-{b}[i]::DOUBLE)), 'DESC')[1:8])/8")


@query("topk_change_score", f"""WITH p AS (SELECT label AS cell, vec_id AS scan_no, embedding AS d,
  lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
s AS (SELECT cell, scan_no, CASE WHEN r IS NULL THEN 1e9 ELSE {SCORE.format(a='d', b='r')} END AS score FROM p)
SELECT cell, scan_no, score, score >= 0.34 AS changed FROM s""")
def topk_change_score(spark, sf):
    o = arrange(B.descriptors(spark, sf), ["cell"], ["scan_no"]).lag({"ref": F.col("desc")}).done()
    s = DS.change_score(F.col("desc"), F.col("ref"))
    return o.select("cell", "scan_no", F.when(F.col("ref").isNull(), 1e9).otherwise(s).alias("score"),
                    DS.changed(s, 0.34).alias("changed"))


@query("desc_mean_removed", """SELECT vec_id AS scan_no, list_transform(embedding, lambda v: v::DOUBLE - (list_sum(list_transform(embedding, lambda u: u::DOUBLE))/64)) AS d
FROM embeddings""")
def desc_mean_removed(spark, sf):
    return B.descriptors(spark, sf).select("scan_no", DS.mean_removed(F.col("desc")).alias("d"))


@query("softmax_top", """WITH e AS (SELECT vec_id AS scan_no, list_transform(embedding, lambda v: exp(v::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings)
SELECT scan_no, list_max(e)/list_sum(e) AS top FROM e""")
def softmax_top(spark, sf):
    return B.descriptors(spark, sf).select("scan_no", F.array_max(DS.softmax(F.col("desc"))).alias("top"))


@query("ema_step", """WITH p AS (SELECT label AS cell, vec_id AS scan_no, embedding AS d, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings)
SELECT cell, scan_no, list_sum(list_transform(range(1,65), lambda i: CASE WHEN r IS NULL THEN d[i]::DOUBLE ELSE 0.95::DOUBLE*r[i]::DOUBLE + 0.05::DOUBLE*d[i]::DOUBLE END)) AS total FROM p""")
def ema_step(spark, sf):
    d = F.transform("desc", lambda v: v.cast("double"))
    o = arrange(B.descriptors(spark, sf).withColumn("desc", d), ["cell"], ["scan_no"]).lag({"ref": F.col("desc")}).done()
    new = DS.ema(F.col("ref"), F.col("desc"), 0.05)
    return o.select("cell", "scan_no", F.aggregate(new, F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("gated_ema_reference", f"""WITH RECURSIVE q AS (SELECT label AS cell, vec_id AS scan_no, list_transform(embedding, lambda v: v::DOUBLE) AS d,
   row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
run AS (
  SELECT cell, scan_no, rn, d AS ref, 0.0::DOUBLE AS score, false AS changed, CAST(0 AS BIGINT) AS run FROM q WHERE rn = 1
  UNION ALL
  SELECT q.cell, q.scan_no, q.rn, CASE WHEN x.s >= {THR} THEN run.ref
      ELSE list_transform(range(1,65), lambda i: 0.95::DOUBLE*run.ref[i] + 0.05::DOUBLE*q.d[i]) END,
    x.s, x.s >= {THR}, CASE WHEN x.s >= {THR} THEN run.run + 1 ELSE 0 END
  FROM run JOIN q ON q.cell = run.cell AND q.rn = run.rn + 1, LATERAL (SELECT {SCORE.format(a='q.d', b='run.ref')} AS s) x)
SELECT cell, scan_no, score, changed, run FROM run""")
def gated_ema_reference(spark, sf):
    return Z.gated_reference(B.descriptors(spark, sf), ["cell"], ["scan_no"], THR, 0.05)


def zone_cells(spark, sf):
    """embeddings -> cells of a camera per 125 vectors: the label is the cell, its k-th vector the k-th scan."""
    d = B.table(spark, sf, "embeddings")
    cam = F.floor(F.col("vec_id") / 125).cast("string")
    k = Window.partitionBy("camera_id", "label").orderBy("vec_id")
    # events hide cells and stand for detections, both as fixed functions of the vector
    c = d.withColumn("camera_id", cam).withColumn("scan_no", F.row_number().over(k).cast("bigint"))
    return c.select("camera_id", F.lit("z0").alias("zone_id"), F.lit("g1").alias("sig"), "scan_no",
                    (F.col("scan_no") * 30.0).alias("t_s"), F.floor(F.col("label") / 5).cast("int").alias("row"),
                    (F.col("label") % 5).cast("int").alias("col"), F.col("embedding").alias("desc"),
                    (F.element_at("embedding", 1) < 0.25).alias("visible"),
                    (F.element_at("embedding", 2) < 0.05).alias("det_hit"),
                    (F.element_at("embedding", 3) < 0.0).alias("fine_hit"),
                    (F.element_at("embedding", 4) < 0.1).alias("sweep_hit"),
                    (F.element_at("embedding", 5) * 2 + 0.5).cast("double").alias("score"))


def zone_scans(spark, sf):
    return Z.pack_scans(zone_cells(spark, sf), ["camera_id", "zone_id", "sig", "scan_no", "t_s"])


PARAMS = ScanParams(thr=THR, mode="change_only", dwell=2, n=1, m=1, rearm_scans=1, mute_after=4, mute_ratio=0.5,
                    unmute_after=2, guard_frac=0.9, guard_spread=0.8, verify_on=True, escalate_after=2,
                    merge_radius=0)


@query("zone_fsm_batch")
def zone_fsm_batch(spark, sf):
    return Z.scan_batch(zone_scans(spark, sf), PARAMS)


@query("zone_fsm_classifier")
def zone_fsm_classifier(spark, sf):
    p = ScanParams(thr=THR, mode="classifier", litter_thr=0.55, max_score=6, n=2, m=3, alert_mode="cooldown",
                   cooldown_s=120, clutter_on=True, mute_after=5, mute_ratio=0.9, unmute_after=2, guard_frac=0.95)
    return Z.scan_batch(zone_scans(spark, sf), p)


@query("zone_clutter_state")
def zone_clutter_state(spark, sf):
    return ST.unpack_clutter(ST.final_states(zone_scans(spark, sf), PARAMS))


@query("stabilise_policy", """WITH v AS (SELECT event_id, value/10.0::DOUBLE AS d, user_id/40.0::DOUBLE AS deg, value/11.0::DOUBLE AS fd FROM events)
SELECT event_id, d <= 40.0 AND deg <= 3.0 AS fits,
  CASE WHEN d <= 40.0 AND deg <= 3.0 THEN CASE WHEN d >= 8.0 THEN fd ELSE d END ELSE 0.0 END AS px,
  d <= 40.0 AND deg <= 3.0 AND (CASE WHEN d >= 8.0 THEN fd ELSE d END)
    + abs(sin(radians(deg)))*sqrt(640.0::DOUBLE*640+480.0::DOUBLE*480)/2 >= 3.0 AS warp FROM v""")
def stabilise_policy(spark, sf):
    o = B.observations(spark, sf)
    zero = F.lit(0.0)
    deg = F.col("user_id") / 40.0
    fits, px, warp = Z.stabilise_policy(F.col("value") / 10.0, zero, deg, zero, F.col("value") / 11.0, deg,
                                        F.lit(640.0), F.lit(480.0), ScanParams())
    return o.select("event_id", fits.alias("fits"), px.alias("px"), warp.alias("warp"))
