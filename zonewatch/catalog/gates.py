"""Queries over persistence, gates and the latch."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonewatch.catalog.base import DAILY, LOG, OBS, query
from zonewatch.operators import gates
from zonewatch.operators.grid import fresh_cells, global_change
from zonewatch.sources import bindings as B

CELL, TIME = ["zone", "user_id"], ["t_us", "event_id"]
SEEN = "value >= 2"  # observations below it stand for occluded cells

RUNS = OBS + """, seen AS (
  SELECT *, value >= 2 AS visible,
    sum(CASE WHEN value >= 2 AND changed THEN 1 ELSE 0 END) OVER w AS s,
    CASE WHEN value >= 2 AND NOT changed THEN sum(CASE WHEN value >= 2 AND changed THEN 1 ELSE 0 END) OVER w END AS b
  FROM obs WINDOW w AS (PARTITION BY zone, user_id ORDER BY t_us, event_id)),
runs AS (SELECT *, CAST(s - coalesce(max(b) OVER (PARTITION BY zone, user_id ORDER BY t_us, event_id), 0) AS BIGINT)
           AS run FROM seen)"""


def _runs(spark, sf):
    return gates.dwell(B.observations(spark, sf), F.col("changed"), CELL, TIME, F.expr(SEEN))


@query("dwell_hot_cells", f"""WITH {RUNS}
SELECT zone, count(*) AS n_obs, count(*) FILTER (changed) AS n_changed,
       count(*) FILTER (run >= 3) AS n_hot, max(run) AS max_run FROM runs GROUP BY zone""")
def dwell_hot_cells(spark, sf):
    return _runs(spark, sf).groupBy("zone").agg(
        F.count(F.lit(1)).alias("n_obs"), F.count_if("changed").alias("n_changed"),
        F.count_if(F.col("run") >= 3).alias("n_hot"), F.max("run").alias("max_run"))


@query("dwell_runs", f"WITH {RUNS} SELECT event_id, run, run >= 3 AS hot, least(1.0::DOUBLE, run/3.0::DOUBLE) AS score FROM runs")
def dwell_runs(spark, sf):
    return _runs(spark, sf).select("event_id", "run", (F.col("run") >= 3).alias("hot"),
                                   F.least(F.lit(1.0), F.col("run") / 3.0).alias("score"))


@query("scan_counters", f"""WITH {RUNS}
SELECT zone, CAST(t_us // 86400000000 AS INTEGER) AS day, count(*) AS n_cells,
  count(*) FILTER (NOT visible) AS n_occluded, count(*) FILTER (visible AND changed) AS n_changed,
  count(*) FILTER (visible AND run >= 2) AS n_raw_hot, max(run) AS max_run,
  coalesce(max(value) FILTER (visible AND run >= 2), 0.0::DOUBLE) AS top_value
FROM runs GROUP BY ALL""")
def scan_counters(spark, sf):
    hot = F.expr(SEEN) & (F.col("run") >= 2)
    return (_runs(spark, sf).withColumn("day", F.floor(F.col("t_us") / 86_400_000_000).cast("int"))
            .groupBy("zone", "day").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(~F.expr(SEEN)).alias("n_occluded"),
        F.count_if(F.expr(SEEN) & F.col("changed")).alias("n_changed"),
        F.count_if(hot).alias("n_raw_hot"), F.max("run").alias("max_run"),
        F.coalesce(F.max(F.when(hot, F.col("value"))), F.lit(0.0)).alias("top_value")))


@query("confirm_n_of_m", f"""WITH {OBS}
SELECT event_id, sum(CAST(changed AS INTEGER)) OVER (PARTITION BY zone ORDER BY t_us, event_id
  ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) >= 4 AS passed FROM obs""")
def confirm_n_of_m(spark, sf):
    return gates.confirm(B.observations(spark, sf), F.col("changed"), 4, 6, ["zone"], TIME) \
        .select("event_id", "passed")


@query("all_absent", f"""WITH {OBS}
SELECT event_id, NOT bool_or(changed) OVER (PARTITION BY zone, user_id ORDER BY t_us, event_id
  ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS absent FROM obs""")
def all_absent(spark, sf):
    return gates.all_absent(B.observations(spark, sf), F.col("changed"), 3, CELL, TIME) \
        .select("event_id", "absent")


@query("confirm_clear_fsm", f"""WITH RECURSIVE {OBS}, seq AS (
  SELECT *, row_number() OVER (PARTITION BY zone, user_id ORDER BY t_us, event_id) AS rn FROM obs),
run AS (
  SELECT zone, user_id, rn, event_id, changed::INT >= 2 AS fired, [changed] AS h FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.zone, s.user_id, s.rn, s.event_id,
    list_count(list_filter(x.h, lambda v: v)) >= 2 AS fired,
    CASE WHEN list_count(list_filter(x.h, lambda v: v)) >= 2 THEN []::BOOLEAN[] ELSE x.h END AS h
  FROM run JOIN seq s ON s.zone = run.zone AND s.user_id = run.user_id AND s.rn = run.rn + 1,
  LATERAL (SELECT list_append(run.h, s.changed)[-3:] AS h) x)
SELECT event_id, fired FROM run""")
def confirm_clear_fsm(spark, sf):
    o = B.observations(spark, sf).select(*CELL, *TIME, F.col("changed").alias("present"))
    return gates.confirm_and_clear(o, 2, 3, CELL, TIME).select("event_id", "fired")


_SPACED = """WITH RECURSIVE {obs}, seq AS (
  SELECT zone, event_id, t_us, row_number() OVER (PARTITION BY zone ORDER BY t_us, event_id) AS rn FROM obs),
run AS (
  SELECT zone, rn, event_id, t_us AS last, true AS passed FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.zone, s.rn, s.event_id, CASE WHEN s.t_us >= run.last + {gap} THEN s.t_us ELSE run.last END,
         s.t_us >= run.last + {gap}
  FROM run JOIN seq s ON s.zone = run.zone AND s.rn = run.rn + 1)
"""


@query("cooldown_dedup", _SPACED.format(obs=OBS, gap=3_600_000_000) + "SELECT event_id, passed FROM run")
def cooldown_dedup(spark, sf):
    return gates.cooldown(B.observations(spark, sf).select("zone", *TIME), 3600, ["zone"], TIME).select("event_id", "passed")


@query("interval_sampler", _SPACED.format(obs=OBS, gap=7_200_000_000 - 1)
       + "SELECT zone, event_id FROM run WHERE passed")
def interval_sampler(spark, sf):
    return gates.sample_interval(B.observations(spark, sf).select("zone", *TIME), 7200, ["zone"], TIME).select("zone", "event_id")


@query("stride_sampler", f"""WITH {OBS}, r AS (
  SELECT zone, event_id, row_number() OVER (PARTITION BY zone ORDER BY t_us, event_id) AS rn FROM obs)
SELECT zone, event_id FROM r WHERE (rn - 1) % 15 = 0""")
def stride_sampler(spark, sf):
    return gates.sample_stride(B.observations(spark, sf), 15, ["zone"], TIME).select("zone", "event_id")


@query("snapshot_due", f"""WITH {LOG} SELECT zone, scan_no,
  row_number() OVER (PARTITION BY zone ORDER BY scan_no) % 10 = 0 OR alert AS due FROM log""")
def snapshot_due(spark, sf):
    out = gates.every_nth(B.scan_log(spark, sf), 10, ["zone"], ["scan_no"])
    return out.select("zone", "scan_no", (F.col("due") | F.col("alert")).alias("due"))


@query("clutter_counts", f"""WITH {OBS} SELECT zone, user_id, count(*) AS total,
  count(*) FILTER (changed) AS litter, count(*) FILTER (changed) / count(*) AS ratio,
  count(*) >= 8 AND count(*) FILTER (changed) / count(*) >= 0.7 AS mutes FROM obs GROUP BY ALL""")
def clutter_counts(spark, sf):
    out = B.observations(spark, sf).groupBy("zone", "user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("changed").alias("litter"))
    return (out.withColumn("ratio", F.col("litter") / F.col("total"))
            .withColumn("mutes", (F.col("total") >= 8) & (F.col("ratio") >= 0.7)))


_CLUTTER = f"""WITH RECURSIVE {OBS}, seq AS (
  SELECT *, row_number() OVER (PARTITION BY zone, user_id ORDER BY t_us, event_id) AS rn FROM obs),
run AS (
  SELECT zone, user_id, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS total,
         CAST(0 AS BIGINT) AS litter, CAST(0 AS BIGINT) AS streak, false AS muted
  FROM seq GROUP BY zone, user_id
  UNION ALL
  SELECT s.zone, s.user_id, s.rn, s.event_id,
    CASE WHEN y.wipe THEN 0 ELSE x.total END, CASE WHEN y.wipe THEN 0 ELSE x.litter END,
    CASE WHEN y.wipe THEN 0 ELSE x.streak END,
    CASE WHEN y.wipe THEN false WHEN run.muted THEN true
         ELSE x.total >= 5 AND x.litter / x.total >= 0.6 END
  FROM run JOIN seq s ON s.zone = run.zone AND s.user_id = run.user_id AND s.rn = run.rn + 1,
  LATERAL (SELECT run.total + 1 AS total, run.litter + s.changed::INT AS litter,
           CASE WHEN s.changed THEN 0 ELSE run.streak + 1 END AS streak) x,
  LATERAL (SELECT run.muted AND x.streak >= 2 AS wipe) y)
"""


@query("clutter_mask_fsm", _CLUTTER + """SELECT event_id, total, litter, streak AS clean_streak, muted
FROM run WHERE rn > 0""")
def clutter_mask_fsm(spark, sf):
    out = gates.clutter_mask(B.observations(spark, sf).select(*CELL, *TIME, "changed"), CELL, TIME, dirty="changed", min_scans=5,
                             mute_ratio=0.6, unmute_after=2)
    return out.select("event_id", "total", "litter", "clean_streak", "muted")


@query("mask_status", _CLUTTER + """, last AS (
  SELECT zone, user_id, arg_max(total, rn) AS total, arg_max(muted, rn) AS muted FROM run GROUP BY ALL)
SELECT zone, count(*) FILTER (muted) AS n_muted, least(1.0::DOUBLE, max(total) / 5.0::DOUBLE) AS progress
FROM last GROUP BY zone""")
def mask_status(spark, sf):
    rows = gates.clutter_mask(B.observations(spark, sf).select(*CELL, *TIME, "changed"), CELL, TIME, dirty="changed", min_scans=5,
                              mute_ratio=0.6, unmute_after=2)
    last = rows.groupBy(*CELL).agg(F.max_by(F.struct("total", "muted"), F.struct(*TIME)).alias("s"))
    return last.groupBy("zone").agg(F.count_if("s.muted").alias("n_muted"),
                                    F.least(F.lit(1.0), F.max("s.total") / 5.0).alias("progress"))


@query("global_change_guard", f"""WITH {OBS}, s AS (
  SELECT zone, CAST(t_us // 86400000000 AS INTEGER) AS day, "row", col, max(value >= 2) AS seen,
         max(value >= 2 AND changed) AS hit FROM obs GROUP BY ALL),
g AS (
  SELECT zone, day, count(*) AS n_cells, count(*) FILTER (seen) AS known, count(*) FILTER (hit) AS changed,
    least(count(DISTINCT "row") FILTER (hit) / greatest(1, count(DISTINCT "row") FILTER (seen)),
          count(DISTINCT col) FILTER (hit) / greatest(1, count(DISTINCT col) FILTER (seen)))::DOUBLE AS spread
  FROM s GROUP BY ALL)
SELECT zone, day, n_cells, known, changed, spread,
  known >= greatest(8.0::DOUBLE, 0.6::DOUBLE * n_cells) AND changed >= 0.6::DOUBLE * known AND spread >= 0.8::DOUBLE AS fires
FROM g""")
def global_change_guard(spark, sf):
    cells = B.observations(spark, sf).select(
        "zone", F.floor(F.col("t_us") / 86_400_000_000).cast("int").alias("day"), "row", "col",
        F.expr(SEEN).alias("visible"), F.lit(True).alias("known"), "changed")
    return global_change(cells, ["zone", "day"], frac=0.6)


@query("persist_from_here", f"""WITH {LOG}, p AS (
  SELECT zone, scan_no, min(n_cells) OVER (PARTITION BY zone ORDER BY scan_no
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= 2 AS persists FROM log)
SELECT zone, count(*) FILTER (persists) AS n_persisting, min(scan_no) FILTER (persists) AS first_scan
FROM p GROUP BY zone""")
def persist_from_here(spark, sf):
    out = gates.persist_from(B.scan_log(spark, sf), F.col("n_cells"), 2, ["zone"], ["scan_no"])
    return out.groupBy("zone").agg(F.count_if("persists").alias("n_persisting"),
                                   F.min(F.when(F.col("persists"), F.col("scan_no"))).alias("first_scan"))


@query("scan_to_scan_change", f"""WITH {LOG} SELECT zone, scan_no,
  abs(n_changed - lag(n_changed) OVER (PARTITION BY zone ORDER BY scan_no)) AS step FROM log""")
def scan_to_scan_change(spark, sf):
    out = gates.previous(B.scan_log(spark, sf), {"prev": F.col("n_changed")}, ["zone"], ["scan_no"])
    return out.select("zone", "scan_no", F.abs(F.col("n_changed") - F.col("prev")).alias("step"))


@query("drift_warnings", f"""WITH {LOG}, d AS (
  SELECT zone, scan_no, shift_px >= 0.75::DOUBLE * 1.2 AS hit,
    sum(CASE WHEN shift_px >= 0.75::DOUBLE * 1.2 THEN 1 ELSE 0 END) OVER w AS s,
    CASE WHEN NOT shift_px >= 0.75::DOUBLE * 1.2 THEN sum(CASE WHEN shift_px >= 0.75::DOUBLE * 1.2 THEN 1 ELSE 0 END) OVER w END AS b
  FROM log WINDOW w AS (PARTITION BY zone ORDER BY scan_no)),
r AS (SELECT zone, scan_no, s - coalesce(max(b) OVER (PARTITION BY zone ORDER BY scan_no), 0) AS run FROM d)
SELECT zone, scan_no, CAST(run AS BIGINT) AS drift_run, run % 3 = 1 AS warn FROM r""")
def drift_warnings(spark, sf):
    out = gates.drift_warnings(B.scan_log(spark, sf), F.col("shift_px"), 1.2, ["zone"], ["scan_no"], every=3)
    return out.select("zone", "scan_no", "drift_run", "warn")


@query("latch_alerts", f"""WITH RECURSIVE {DAILY}, rare AS (SELECT DISTINCT zone, CAST(t_us // 86400000000 AS INTEGER) AS day, "row", col FROM obs WHERE value >= 300),
scans AS (
  SELECT d.zone, d.day, coalesce(list([c."row", c.col]) FILTER (c.zone IS NOT NULL), []) AS hot
  FROM (SELECT DISTINCT zone, CAST(t_us // 86400000000 AS INTEGER) AS day FROM obs) d
  LEFT JOIN rare c ON c.zone = d.zone AND c.day = d.day GROUP BY d.zone, d.day),
seq AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY day) AS rn FROM scans),
run AS (
  SELECT zone, CAST(0 AS BIGINT) AS rn, 0 AS day, []::INTEGER[][] AS latched, CAST(0 AS BIGINT) AS clean,
         CAST(0 AS BIGINT) AS n_fresh, false AS alert, false AS escalated, false AS rearmed
  FROM seq GROUP BY zone
  UNION ALL
  SELECT s.zone, s.rn, s.day,
    CASE WHEN z.rearm THEN []::INTEGER[][] WHEN len(y.fresh) >= 1 THEN list_concat(x.grown, y.fresh) ELSE x.grown END,
    z.clean, len(y.fresh), len(y.fresh) >= 1, len(y.fresh) >= 1 AND len(x.grown) > 0, z.rearm
  FROM run JOIN seq s ON s.zone = run.zone AND s.rn = run.rn + 1,
  LATERAL (SELECT list_concat(run.latched, list_filter(s.hot, lambda h:
     NOT list_contains(run.latched, h) AND len(list_filter(run.latched, lambda l:
       abs(h[1]-l[1]) <= 1 AND abs(h[2]-l[2]) <= 1)) > 0)) AS grown) x,
  LATERAL (SELECT list_filter(s.hot, lambda h: NOT list_contains(x.grown, h)) AS fresh) y,
  LATERAL (SELECT CASE WHEN len(s.hot) > 0 THEN 0 ELSE run.clean + 1 END AS clean,
     len(s.hot) = 0 AND run.clean + 1 >= 1 AND len(x.grown) > 0 AS rearm) z)
SELECT zone, day, CAST(n_fresh AS INTEGER) AS n_fresh, alert, escalated, rearmed FROM run WHERE rn > 0""")
def latch_alerts(spark, sf):
    o = B.observations(spark, sf).withColumn("day", F.floor(F.col("t_us") / 86_400_000_000).cast("int"))
    days = o.select("zone", "day").distinct()
    hot = (o.filter("value >= 300").select("zone", "day", "row", "col").distinct().groupBy("zone", "day")
           .agg(F.collect_list("row").alias("hot_rows"), F.collect_list("col").alias("hot_cols")))
    none = F.array().cast("array<int>")
    scans = days.join(hot, ["zone", "day"], "left").select(
        "zone", "day", (F.col("day") * 86400.0).alias("t_s"),
        F.coalesce("hot_rows", none).alias("hot_rows"), F.coalesce("hot_cols", none).alias("hot_cols"))
    out = gates.latch_alerts(scans, ["zone"], ["day"], n=1, m=1, merge_radius=1, rearm_scans=1)
    return out.select("zone", "day", "n_fresh", "alert", "escalated", "rearmed")


@query("fresh_cells", f"""WITH {DAILY} SELECT h.zone, h.day, h."row", h.col FROM daily h
WHERE NOT EXISTS (SELECT 1 FROM daily p WHERE p.zone = h.zone AND p.day = h.day - 1
  AND abs(p."row" - h."row") <= 1 AND abs(p.col - h.col) <= 1)""")
def fresh(spark, sf):
    hot = B.daily_cells(spark, sf).select("zone", "day", "row", "col")
    return fresh_cells(hot, hot.withColumn("day", F.col("day") + 1), ["zone", "day"], 1)
