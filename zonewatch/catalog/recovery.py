"""Queries over the recovery paths of the zone scan: moved scenes, redrawn grids, muted cells and their release."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from zonewatch.catalog.base import query
from zonewatch.catalog.more import PLAIN
from zonewatch.catalog.scans import SCORE, THR, zone_scans
from zonewatch.operators import zone_scan as Z
from zonewatch.sources import bindings as B

CELLS = """c AS (SELECT CAST(vec_id // 125 AS VARCHAR) AS camera_id, label, row_number() OVER (PARTITION BY vec_id // 125, label ORDER BY vec_id) AS scan_no,
   list_transform(embedding, lambda v: v::DOUBLE) AS d, embedding[1] < 0.25 AS visible FROM embeddings)"""
BLEND = "list_transform(range(1,65), lambda i: 0.95::DOUBLE*run.ref[i] + 0.05::DOUBLE*q.d[i])"


def gate_sql(rows: str) -> str:
    """The change gate per cell over `rows` (camera_id, label, scan_no, rn, era, d); a new era starts without a reference."""
    return f"""run AS (
  SELECT camera_id, label, scan_no, rn, era, d AS ref, true AS first, false AS changed, CAST(0 AS BIGINT) AS run FROM {rows} WHERE rn = 1
  UNION ALL
  SELECT q.camera_id, q.label, q.scan_no, q.rn, q.era, CASE WHEN x.f THEN q.d WHEN x.s >= {THR} THEN run.ref ELSE {BLEND} END, x.f,
    NOT x.f AND x.s >= {THR}, CASE WHEN NOT x.f AND x.s >= {THR} THEN run.run + 1 ELSE 0 END
  FROM run JOIN {rows} q ON q.camera_id=run.camera_id AND q.label=run.label AND q.rn=run.rn+1,
  LATERAL (SELECT {SCORE.format(a='q.d', b='run.ref')} AS s, q.era <> run.era AS f) x)"""


@query("shift_resets", f"""WITH RECURSIVE {CELLS}, s AS (SELECT DISTINCT camera_id, scan_no, (scan_no * 7 + CAST(camera_id AS BIGINT)) % 6 = 5 AS moved FROM c),
e AS (SELECT *, count(*) FILTER (moved) OVER (PARTITION BY camera_id ORDER BY scan_no) AS era FROM s),
v AS (SELECT c.*, e.era, row_number() OVER (PARTITION BY camera_id, label ORDER BY scan_no) AS rn FROM c JOIN e USING (camera_id, scan_no) WHERE visible AND NOT moved),
{gate_sql('v')}
SELECT e.camera_id, e.scan_no, e.moved AS ref_reset, count(run.label) FILTER (run.first OR run.changed)::INTEGER AS n_changed, count(run.label) FILTER (run.run >= 2)::INTEGER AS n_hot
FROM e LEFT JOIN run USING (camera_id, scan_no) GROUP BY ALL""")
def shift_resets(spark, sf):
    """A scene that moves further than the limit clears references and runs and ends its scan."""
    moved = (F.col("scan_no") * 7 + F.col("camera_id").cast("bigint")) % 6 == 5
    scans = zone_scans(spark, sf).withColumn("shift_px", F.when(moved, PLAIN.shift_thr).otherwise(PLAIN.shift_thr - 0.5))
    return Z.scan_batch(scans, PLAIN).select("camera_id", "scan_no", "ref_reset", "n_changed", "n_hot")


@query("grid_changes", f"""WITH RECURSIVE {CELLS},
v AS (SELECT *, scan_no // 5 AS era, row_number() OVER (PARTITION BY camera_id, label ORDER BY scan_no) AS rn FROM c WHERE visible),
{gate_sql('v')}
SELECT s.camera_id, s.scan_no, 'g' || s.scan_no // 5 % 2 AS sig, count(run.label) FILTER (run.first OR run.changed)::INTEGER AS n_changed, count(run.label) FILTER (run.run >= 2)::INTEGER AS n_hot
FROM (SELECT DISTINCT camera_id, scan_no FROM c) s LEFT JOIN run USING (camera_id, scan_no) GROUP BY ALL""")
def grid_changes(spark, sf):
    """A zone whose grid is redrawn every fifth scan, back and forth: each time its cells start anew."""
    scans = zone_scans(spark, sf).withColumn("sig", F.concat(F.lit("g"), (F.floor(F.col("scan_no") / 5) % 2).cast("string")))
    return Z.scan_batch(scans, PLAIN).select("camera_id", "scan_no", "sig", "n_changed", "n_hot")


MUTING = replace(PLAIN, clutter_on=True, mute_after=3, mute_ratio=0.5, unmute_after=2)


@query("muted_cells", f"""WITH RECURSIVE {CELLS},
o AS (SELECT CAST(vec_id // 125 AS VARCHAR) AS camera_id, vec_id % 125 % 12 * 30.0::DOUBLE + 5 AS t_s, (label // 5) || ',' || (label % 5) AS cell FROM embeddings WHERE vec_id % 23 = 11),
t AS (SELECT DISTINCT camera_id, scan_no, scan_no * 30.0::DOUBLE AS t_s FROM c),
p AS (SELECT o.camera_id, t.scan_no, o.t_s, o.cell FROM o ASOF JOIN t ON o.camera_id = t.camera_id AND o.t_s <= t.t_s),
l AS (SELECT camera_id, scan_no, arg_max(cell, (t_s, 'unmute:' || cell)) AS cell FROM p GROUP BY ALL),
u AS (SELECT c.camera_id, c.label, c.scan_no, c.d, c.visible, coalesce(l.cell = (c.label // 5) || ',' || (c.label % 5), false) AS freed FROM c LEFT JOIN l USING (camera_id, scan_no)),
q0 AS (SELECT *, row_number() OVER (PARTITION BY camera_id, label ORDER BY scan_no) AS rn,
  sum(freed::INTEGER) OVER (PARTITION BY camera_id, label ORDER BY scan_no) AS frees FROM u),
q1 AS (SELECT camera_id, label, scan_no, d, frees, row_number() OVER (PARTITION BY camera_id, label ORDER BY scan_no) AS rn FROM q0 WHERE visible),
run AS (
  SELECT camera_id, label, scan_no, rn, frees, d AS ref, true AS first, false AS changed, 0::BIGINT AS run, 0::BIGINT AS total, 0::BIGINT AS litter, 0::BIGINT AS streak, false AS muted FROM q1 WHERE rn = 1
  UNION ALL
  SELECT q.camera_id, q.label, q.scan_no, q.rn, q.frees, CASE WHEN x.ch THEN run.ref ELSE {BLEND} END, false, x.ch, y.run,
    CASE WHEN NOT y.counted THEN y.total WHEN z.wipe THEN 0 ELSE z.total END, CASE WHEN NOT y.counted THEN y.litter WHEN z.wipe THEN 0 ELSE z.litter END,
    CASE WHEN NOT y.counted THEN y.streak WHEN z.wipe THEN 0 ELSE z.streak END,
    CASE WHEN NOT y.counted THEN y.muted ELSE NOT z.wipe AND (y.muted OR (z.total >= 3 AND z.litter / z.total >= 0.5)) END
  FROM run JOIN q1 q ON q.camera_id=run.camera_id AND q.label=run.label AND q.rn=run.rn+1,
  LATERAL (SELECT {SCORE.format(a='q.d', b='run.ref')} >= {THR} AS ch, q.frees <> run.frees AS freed) x,
  LATERAL (SELECT CASE WHEN x.ch THEN run.run + 1 ELSE 0 END AS run, CASE WHEN x.freed THEN 0 ELSE run.total END AS total, CASE WHEN x.freed THEN 0 ELSE run.litter END AS litter,
    CASE WHEN x.freed THEN 0 ELSE run.streak END AS streak, run.muted AND NOT x.freed AS muted, x.ch OR (run.muted AND NOT x.freed) AS counted) y,
  LATERAL (SELECT y.total + 1 AS total, y.litter + CASE WHEN y.run >= 2 AND x.ch THEN 1 ELSE 0 END AS litter, CASE WHEN y.run >= 2 AND x.ch THEN 0 ELSE y.streak + 1 END AS streak,
    y.muted AND (CASE WHEN y.run >= 2 AND x.ch THEN 0 ELSE y.streak + 1 END) >= 2 AS wipe) z)
SELECT t.camera_id, t.scan_no, l.cell AS freed, count(run.label) FILTER (run.first OR run.changed)::INTEGER AS n_changed, count(run.label) FILTER (run.run >= 2)::INTEGER AS n_raw_hot,
  count(run.label) FILTER (run.run >= 2 AND run.muted)::INTEGER AS n_muted_hit, count(run.label) FILTER (run.run >= 2 AND NOT run.muted)::INTEGER AS n_hot
FROM t LEFT JOIN l USING (camera_id, scan_no) LEFT JOIN run USING (camera_id, scan_no) GROUP BY ALL""")
def muted_cells(spark, sf):
    """Cells that keep turning hot are muted, calm ones released; orders release single cells."""
    v = F.col("vec_id")
    cell = F.concat_ws(",", F.floor(F.col("label") / 5), F.col("label") % 5)
    orders = B.table(spark, sf, "embeddings").filter("vec_id % 23 = 11").select(
        F.floor(v / 125).cast("string").alias("camera_id"), F.lit("z0").alias("zone_id"), (v % 125 % 12 * 30.0 + 5).alias("t_s"),
        F.concat(F.lit("unmute:"), cell).alias("order"))
    found = Z.scan_batch(Z.with_control(zone_scans(spark, sf), orders), MUTING)
    scans = Z.with_control(zone_scans(spark, sf), orders).select("camera_id", "scan_no", F.regexp_replace("control", "^unmute:", "").alias("freed"))
    return found.select("camera_id", "scan_no", "n_changed", "n_raw_hot", "n_muted_hit", "n_hot").join(scans, ["camera_id", "scan_no"])
