"""Queries over scan logs, truth intervals and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonewatch.catalog.base import LOG, OBS, query
from zonewatch.functions import grading
from zonewatch.operators import sampling as S
from zonewatch.plans import calibrate, runlog
from zonewatch.session import materialize
from zonewatch.sources import bindings as B

BY = ["zone"]

TRUTH = LOG + """, truth AS (SELECT zone, event_id, CAST(t_us AS DOUBLE)/1000000.0::DOUBLE AS a,
  CAST(t_us AS DOUBLE)/1000000.0::DOUBLE + value*60 AS b FROM obs WHERE value >= 120),
al AS (SELECT zone, t_s FROM log WHERE alert),
sp AS (SELECT zone, min(t_s) AS t0, max(t_s) AS t1, count(*) AS n_scans FROM log GROUP BY zone)"""

RATE = "CASE WHEN {h} >= 2.0 THEN {n}/greatest({h}/24.0::DOUBLE, 1e-9) END"
VERDICT = ("CASE WHEN {r} IS NULL THEN 'too short' WHEN {r} < 1 THEN 'pass' "
           "WHEN {r} < 2 THEN 'acceptable' ELSE 'fail' END")


def _truth(spark, sf):
    o = B.observations(spark, sf).filter("value >= 120")
    a = F.col("t_us").cast("double") / 1_000_000.0
    return o.select("zone", "event_id", a.alias("a"), (a + F.col("value") * 60).alias("b"))


@query("run_summary", f"""WITH {LOG} SELECT zone, max(t_s)-min(t_s) AS span_s, count(*) AS n_scans,
  count(*) FILTER (dirty) AS n_dirty, 100.0::DOUBLE*count(*) FILTER (dirty)/count(*) AS dirty_pct,
  count(*) FILTER (alert) AS n_alerts, CAST(sum(n_dropped) AS BIGINT) AS n_dropped,
  count(*) FILTER (shift_px >= 3.0) AS n_shifted, count(*) FILTER (n_hot > 0) AS n_with_hot,
  avg(n_changed) AS mean_changed, arg_max(mask_progress, t_s) AS last_progress FROM log GROUP BY zone""")
def run_summary(spark, sf):
    return runlog.run_summary(B.scan_log(spark, sf), BY)


_R = RATE.format(n="n", h="hours")


@query("false_alarms_per_day", f"""WITH {LOG}, s AS (SELECT zone, (max(t_s)-min(t_s))/3600.0::DOUBLE AS hours,
  count(*) FILTER (alert) AS n FROM log GROUP BY zone), r AS (SELECT *, {_R} AS per_day FROM s)
SELECT zone, n AS n_alerts, hours, per_day, {VERDICT.format(r='per_day')} AS verdict FROM r""")
def false_alarms_per_day(spark, sf):
    return runlog.false_alarms(B.scan_log(spark, sf), BY)


@query("clean_time", f"""WITH {TRUTH} SELECT zone, greatest(1e-9, max(t1)-max(t0)
  - coalesce(sum(least(b,t1)-greatest(a,t0)),0)) AS clean_s FROM sp LEFT JOIN truth USING (zone) GROUP BY zone""")
def clean_time(spark, sf):
    return runlog.clean_time(_truth(spark, sf), B.scan_log(spark, sf), BY)


@query("alerts_in_truth", f"""WITH {TRUTH} SELECT zone, t_s, EXISTS (SELECT 1 FROM truth t WHERE t.zone=al.zone
  AND al.t_s BETWEEN t.a AND t.b) AS inside FROM al""")
def alerts_in_truth(spark, sf):
    alerts = B.scan_log(spark, sf).filter("alert").select("zone", "t_s")
    return runlog.alerts_in_truth(alerts, _truth(spark, sf), BY)


@query("event_recall_latency", f"""WITH {TRUTH}, f AS (SELECT t.zone, t.event_id, t.a,
   min(al.t_s) - t.a AS lat FROM truth t LEFT JOIN al ON al.zone=t.zone AND al.t_s BETWEEN t.a AND t.b + 180 GROUP BY t.zone, t.event_id, t.a),
l AS (SELECT zone, lat, row_number() OVER (PARTITION BY zone ORDER BY lat) - 1 AS i, count(*) OVER (PARTITION BY zone) AS n
  FROM f WHERE lat IS NOT NULL),
r AS (SELECT zone, count(*) AS n_events, count(lat) AS n_hit, max(lat) AS worst_s FROM f GROUP BY zone),
v AS (SELECT zone, count(*) FILTER (ins) AS n_true, count(*) FILTER (NOT ins) AS n_false FROM (
  SELECT zone, EXISTS (SELECT 1 FROM truth t WHERE t.zone=al.zone AND al.t_s BETWEEN t.a AND t.b) AS ins FROM al) GROUP BY zone),
c AS (SELECT zone, greatest(1e-9, max(t1)-max(t0)-coalesce(sum(least(b,t1)-greatest(a,t0)),0)) AS clean_s
  FROM sp LEFT JOIN truth USING (zone) GROUP BY zone),
z AS (SELECT zone, n_events, n_hit, worst_s, (SELECT max(lat) FROM l WHERE l.zone=r.zone AND i = n // 2) AS median_s,
  coalesce(n_true,0) AS n_true, coalesce(n_false,0) AS n_false, clean_s,
  {RATE.format(n='coalesce(n_false,0)', h='(clean_s/3600.0::DOUBLE)')} AS false_per_day
  FROM r LEFT JOIN v USING (zone) LEFT JOIN c USING (zone))
SELECT *, {VERDICT.format(r='false_per_day')} AS verdict FROM z""")
def event_recall_latency(spark, sf):
    return runlog.event_recall(materialize(B.scan_log(spark, sf)), _truth(spark, sf), BY)


@query("post_warm_rate", f"""WITH {LOG}, w AS (SELECT zone, min(t_s) FILTER (mask_progress >= 1.0) AS warm, min(t_s) AS t0,
  max(t_s) AS t1 FROM log GROUP BY zone), s AS (SELECT w.zone, warm, (t1-warm)/3600.0::DOUBLE AS hours,
  (SELECT count(*) FROM log l WHERE l.zone=w.zone AND l.alert AND l.t_s >= warm) AS n FROM w WHERE warm > t0),
r AS (SELECT *, {_R} AS per_day FROM s)
SELECT zone, warm, n AS n_after, hours, per_day, {VERDICT.format(r='per_day')} AS verdict FROM r""")
def post_warm_rate(spark, sf):
    return runlog.post_warm_rate(B.scan_log(spark, sf), BY)


@query("tumbling_report", f"""WITH {LOG} SELECT zone, CAST(floor(t_s/21600) AS BIGINT) AS bin, count(*) AS n_scans,
  count(*) FILTER (n_hot > 0) AS n_with_hot, count(*) FILTER (alert) AS n_alerts, avg(n_changed) AS mean_changed
  FROM log GROUP BY ALL""")
def tumbling_report(spark, sf):
    return runlog.time_bins(B.scan_log(spark, sf), BY, minutes=360)


@query("alert_cell_counts", f"""WITH {LOG}, c AS (SELECT zone, unnest(string_split(hot_cells,' ')) AS cell FROM log WHERE alert)
SELECT zone, cell, count(*) AS n FROM c WHERE cell <> '' GROUP BY ALL""")
def alert_cell_counts(spark, sf):
    return runlog.alert_cells(B.scan_log(spark, sf), BY)


@query("alert_cell_concentration", f"""WITH {LOG}, c AS (SELECT zone, unnest(string_split(hot_cells,' ')) AS cell FROM log WHERE alert),
k AS (SELECT zone, cell, count(*) AS n FROM c WHERE cell <> '' GROUP BY ALL)
SELECT zone, count(*) AS n_cells, count(*) FILTER (n >= 2) AS n_repeated,
  count(*) FILTER (n >= 2) > 0.4 * count(*) AS concentrated FROM k GROUP BY zone""")
def alert_cell_concentration(spark, sf):
    return runlog.cell_concentration(B.scan_log(spark, sf), BY)


_RESETS = """p AS (SELECT zone, mask_progress, lag(mask_progress) OVER (PARTITION BY zone ORDER BY scan_no) AS prev FROM log),
rs AS (SELECT zone, count(*) FILTER (mask_progress < prev - 1e-9) AS n_resets FROM p GROUP BY zone)"""


@query("log_resets", f"WITH {LOG}, {_RESETS} SELECT * FROM rs")
def log_resets(spark, sf):
    return runlog.progress_resets(B.scan_log(spark, sf), BY, ["scan_no"])


@query("reject_share", f"""WITH {LOG}, {_RESETS} SELECT zone, CAST(sum(n_verify_dropped) AS BIGINT) AS n_rejected,
  CAST(sum(n_verify_boxes) AS BIGINT) AS n_boxes,
  100.0::DOUBLE*sum(n_verify_dropped)/greatest(1, sum(n_verify_dropped)+sum(n_verify_boxes)) AS rejected_pct,
  count(*) FILTER (mask_progress >= 1.0)/count(*) AS ripe_share, CAST(sum(n_muted_hit) AS BIGINT) AS n_muted_hit,
  avg(ms) AS mean_ms, max(n_resets) AS n_resets FROM log JOIN rs USING (zone) GROUP BY zone""")
def reject_share(spark, sf):
    return runlog.reject_share(B.scan_log(spark, sf), BY, ["scan_no"])


@query("log_stitch", f"""WITH {LOG}, t AS (SELECT zone, scan_no, CAST((scan_no % 50) * 30 AS DOUBLE) AS t_s FROM log),
p AS (SELECT *, lag(t_s) OVER (PARTITION BY zone ORDER BY scan_no) AS prev FROM t),
j AS (SELECT *, CASE WHEN t_s < prev THEN prev + 30 ELSE 0 END AS jump, CASE WHEN t_s < prev THEN 1 ELSE 0 END AS new_seg FROM p)
SELECT zone, scan_no, t_s + sum(jump) OVER w AS t_run, CAST(sum(new_seg) OVER w AS BIGINT) AS segment FROM j
WINDOW w AS (PARTITION BY zone ORDER BY scan_no)""")
def log_stitch(spark, sf):
    t = B.scan_log(spark, sf).select("zone", "scan_no", ((F.col("scan_no") % 50) * 30).cast("double").alias("t_s"))
    return runlog.stitch_segments(t, BY, ["scan_no"]).select("zone", "scan_no", "t_run", "segment")


@query("first_scan_after_event", f"""WITH {LOG}, e AS (SELECT zone, event_id, CAST(t_us AS DOUBLE) AS t FROM obs WHERE value >= 120),
s AS (SELECT zone, scan_no, t_s*1000000.0::DOUBLE AS ts_ FROM log)
SELECT e.zone, e.event_id, e.t, s.scan_no FROM e ASOF LEFT JOIN s ON e.zone=s.zone AND e.t <= s.ts_""")
def first_scan_after_event(spark, sf):
    e = B.observations(spark, sf).filter("value >= 120").select(
        "zone", "event_id", F.col("t_us").cast("double").alias("t"))
    s = B.scan_log(spark, sf).select("zone", "scan_no", (F.col("t_s") * 1_000_000.0).alias("ts_"))
    return runlog.first_scan_after(e, s, BY, "t", "ts_", "scan_no")


_EV = LOG + """, ev AS (SELECT zone, min(scan_no) + 100 AS ev_scan FROM log GROUP BY zone),
sc AS (SELECT l.zone, l.scan_no, n_changed AS n_raw_hot, n_hot, alert, ev_scan FROM log l JOIN ev USING (zone)),
fi AS (SELECT zone, max(ev_scan) AS ev_scan, min(scan_no) FILTER (alert AND scan_no >= ev_scan) AS alert_scan,
  min(scan_no) FILTER (n_raw_hot >= 2 AND scan_no >= ev_scan) AS raw_scan,
  count(*) FILTER (alert AND scan_no < ev_scan) AS n_false FROM sc GROUP BY zone)"""


def _event_scans(spark, sf):
    log = B.scan_log(spark, sf)
    ev = log.groupBy("zone").agg((F.min("scan_no") + 100).alias("ev_scan"))
    return log.select("zone", "scan_no", F.col("n_changed").alias("n_raw_hot"), "n_hot", "alert"), ev


@query("latency_breakdown", f"""WITH {_EV} SELECT fi.*,
  count(*) FILTER (w AND NOT n_raw_hot >= 2) AS n_not_persistent, count(*) FILTER (w AND n_raw_hot >= 2 AND NOT n_hot >= 2) AS n_rejected,
  count(*) FILTER (w AND n_raw_hot >= 2 AND n_hot >= 2 AND NOT alert) AS n_held, max(alert_scan - fi.ev_scan) AS delay
FROM (SELECT sc.*, sc.scan_no >= fi2.ev_scan AND (fi2.alert_scan IS NULL OR sc.scan_no <= fi2.alert_scan) AS w
      FROM sc JOIN fi fi2 USING (zone)) s JOIN fi USING (zone) GROUP BY ALL""")
def latency_breakdown(spark, sf):
    scans, ev = _event_scans(spark, sf)
    return runlog.latency_breakdown(scans, ev, BY, min_hot=2)


@query("first_alert_minutes", f"""WITH {_EV}, d AS (SELECT zone, alert_scan - ev_scan AS delay_scans FROM fi)
SELECT zone, delay_scans, i AS interval_s, delay_scans*i/60.0::DOUBLE AS minutes,
  coalesce(delay_scans*i/60.0::DOUBLE > 3.0, true) AS late FROM d, (VALUES (15),(30),(60)) v(i)""")
def first_alert_minutes(spark, sf):
    scans, ev = _event_scans(spark, sf)
    return runlog.first_alert_scan(scans.join(ev, "zone"), BY, [15, 30, 60])


@query("event_outcome", f"""WITH {LOG}, ev AS (SELECT zone, day, min(cell) AS cell FROM (
   SELECT zone, scan_no // 24 AS day, unnest(string_split(hot_cells,' ')) AS cell FROM log WHERE n_hot >= 2) WHERE cell <> '' GROUP BY ALL),
al AS (SELECT zone, scan_no // 24 AS day, scan_no, hot_cells FROM log WHERE alert),
o AS (SELECT ev.zone, ev.day, (SELECT min(scan_no) FROM al WHERE al.zone=ev.zone AND al.day=ev.day) AS first_any,
  (SELECT min(scan_no) FROM al WHERE al.zone=ev.zone AND al.day=ev.day AND list_contains(string_split(al.hot_cells,' '), ev.cell)) AS first_on_target FROM ev)
SELECT *, CASE WHEN first_on_target IS NOT NULL THEN 'on_target' WHEN first_any IS NOT NULL THEN 'elsewhere' ELSE 'silent' END AS outcome FROM o""")
def event_outcome(spark, sf):
    log = B.scan_log(spark, sf).withColumn("day", F.floor(F.col("scan_no") / 24))
    cell = F.explode(F.split("hot_cells", " "))
    ev = (log.filter("n_hot >= 2").select("zone", "day", cell.alias("cell")).filter("cell <> ''")
          .groupBy("zone", "day").agg(F.min("cell").alias("cell")))
    alerts = log.filter("alert")
    hit = alerts.select("zone", "day", "scan_no", cell.alias("cell")).join(ev, ["zone", "day", "cell"], "left_semi")
    return runlog.event_outcome(alerts, hit, ev, ["zone", "day"]).drop("cell")


@query("parameter_sweep", f"""WITH {OBS} SELECT zone, thr, count(*) AS n_scans, count(*) FILTER (value >= thr) AS n_changed,
  count(*) FILTER (value >= 2*thr) AS n_hot FROM obs, (VALUES (25.0::DOUBLE),(50.0::DOUBLE),(75.0::DOUBLE)) p(thr) GROUP BY ALL""")
def parameter_sweep(spark, sf):
    s = S.sweep(B.observations(spark, sf), [{"thr": 25.0}, {"thr": 50.0}, {"thr": 75.0}])
    return s.groupBy("zone", "thr").agg(
        F.count(F.lit(1)).alias("n_scans"), F.count_if(F.col("value") >= F.col("thr")).alias("n_changed"),
        F.count_if(F.col("value") >= 2 * F.col("thr")).alias("n_hot"))


@query("sweep_summary", f"""WITH {LOG} SELECT zone, thr, arg_min(100.0::DOUBLE*n_changed/greatest(1,n_cells), scan_no) AS first_changed_pct,
  count(*) FILTER (n_changed >= 3) AS n_guard, count(*) FILTER (shift_px >= thr) AS n_shift,
  count(*) FILTER (alert) AS n_alerts FROM log, (VALUES (1.0::DOUBLE),(2.0::DOUBLE)) p(thr) GROUP BY ALL""")
def sweep_summary(spark, sf):
    s = S.sweep(B.scan_log(spark, sf), [{"thr": 1.0}, {"thr": 2.0}]).withColumns({
        "global_change": F.col("n_changed") >= 3, "ref_reset": F.col("shift_px") >= F.col("thr")})
    return runlog.sweep_summary(s, ["zone", "thr"])


@query("scenario_summary", f"""WITH {LOG} SELECT zone AS scenario, max(n_hot) AS max_hot, count(*) FILTER (shift_px >= 2) AS n_reset,
  count(*) FILTER (n_changed >= 3) AS n_guard, max(n_hot) > 0 AS passed FROM log GROUP BY zone""")
def scenario_summary(spark, sf):
    s = B.scan_log(spark, sf).withColumns({"global_change": F.col("n_changed") >= 3,
                                           "ref_reset": F.col("shift_px") >= 2}).withColumnRenamed("zone", "scenario")
    return runlog.scenario_summary(s, ["scenario"])


@query("negative_yield", f"""WITH {LOG} SELECT zone, count(*) AS n_scans, CAST(sum(n_verify_boxes) AS BIGINT) AS n_crops,
  sum(n_verify_boxes)/count(*) AS per_scan FROM log GROUP BY zone""")
def negative_yield(spark, sf):
    o = B.observations(spark, sf)
    return runlog.negative_yield(o.filter(F.col("value") >= B.HOT_THR), B.scan_log(spark, sf), BY)


@query("latest_status", f"""WITH {LOG} SELECT zone, max(scan_no) AS scan_no, arg_max(n_hot, scan_no) AS n_hot,
  arg_max(alert, scan_no) AS alert FROM log GROUP BY zone""")
def latest_status(spark, sf):
    return runlog.latest_status(B.scan_log(spark, sf).select("zone", "scan_no", "n_hot", "alert"), BY)


@query("recent_alerts", f"""WITH {LOG}, r AS (SELECT zone, scan_no, row_number() OVER (PARTITION BY zone ORDER BY t_s DESC, scan_no DESC) AS rn
  FROM log WHERE alert) SELECT zone, scan_no FROM r WHERE rn <= 12""")
def recent_alerts(spark, sf):
    return S.recent(B.scan_log(spark, sf).filter("alert"), 12, BY, "t_s", ["scan_no"]).select("zone", "scan_no")


@query("cell_status", f"""WITH {OBS} SELECT CASE WHEN value >= 100 THEN 'hot' WHEN user_id % 16 = 3 THEN 'muted'
  WHEN value - 40 > 0 THEN 'warm' ELSE 'grid' END AS status, count(*) AS n FROM obs GROUP BY ALL""")
def cell_status(spark, sf):
    s = grading.cell_status(F.col("value") >= B.HOT_THR, F.col("col") == 3, F.col("value") - 40)
    return B.observations(spark, sf).groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_tags", f"""WITH {LOG} SELECT CASE WHEN alert THEN 'alert' WHEN shift_px >= 2 THEN 'reseed' WHEN dirty THEN 'dirty' ELSE 'clean' END AS tag,
  count(*) AS n FROM log GROUP BY ALL""")
def scan_tags(spark, sf):
    tag = grading.scan_tag(F.col("alert"), F.col("shift_px") >= 2, F.col("dirty"))
    return B.scan_log(spark, sf).groupBy(tag.alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("candidate_cap", f"""WITH {OBS}, c AS (SELECT zone, t_us // 86400000000 AS day, event_id, value,
  row_number() OVER (PARTITION BY zone, t_us // 86400000000 ORDER BY value DESC, event_id) AS rn,
  count(*) OVER (PARTITION BY zone, t_us // 86400000000) AS n FROM obs WHERE changed)
SELECT zone, day, event_id, greatest(n - 24, 0) AS n_dropped FROM c WHERE rn <= 24""")
def candidate_cap(spark, sf):
    c = B.observations(spark, sf).filter("changed").withColumn("day", F.floor(F.col("t_us") / 86_400_000_000))
    return S.cap_candidates(c, 24, ["zone", "day"], "value", ["event_id"]).select("zone", "day", "event_id", "n_dropped")


@query("noise_floor", f"""WITH {OBS}, s AS (SELECT zone, value/25.0::DOUBLE AS score, t_us // 3600000000 AS scan_no FROM obs WHERE NOT changed),
j AS (SELECT zone, value/20.0::DOUBLE AS px FROM obs), q AS (SELECT zone, count(*) AS n_scores, count(DISTINCT scan_no) AS n_scans,
  quantile_cont(score,.5) AS p50, quantile_cont(score,.99) AS p99, quantile_cont(score,.999) AS p999 FROM s GROUP BY zone),
sp AS (SELECT zone, quantile_cont(score,.5) AS s50, quantile_cont(score,.99) AS s99 FROM s GROUP BY zone),
jj AS (SELECT zone, quantile_cont(px,.99) AS j99 FROM j GROUP BY zone)
SELECT *, least(greatest(1.5*p999,4.0),10.0) AS thr, least(greatest(1.5*s99,2.0),6.0) AS min_px, j99 > 6.0 AS jitter_high,
  least(greatest(1.5*p999,4.0),10.0) >= 9.5 AS noisy FROM q JOIN sp USING (zone) JOIN jj USING (zone)""")
def noise_floor(spark, sf):
    o = B.observations(spark, sf)
    clean = o.filter("not changed")
    scores = clean.select("zone", (F.col("value") / 25.0).alias("score"),
                          F.floor(F.col("t_us") / 3_600_000_000).alias("scan_no"))
    return calibrate.noise_floor(scores, clean.select("zone", (F.col("value") / 25.0).alias("px")),
                                 o.select("zone", (F.col("value") / 20.0).alias("px")), BY)


@query("score_threshold", f"""WITH {OBS}, s AS (SELECT zone, value/600.0::DOUBLE AS score, t_us // 3600000000 AS scan_no FROM obs),
q AS (SELECT zone, count(*) AS n, quantile_cont(score,.5) AS p50, quantile_cont(score,.9) AS p90, quantile_cont(score,.99) AS p99,
  quantile_cont(score,.999) AS p999, max(score) AS max_score, count(DISTINCT scan_no) AS n_scans FROM s GROUP BY zone),
t AS (SELECT *, least(greatest(max_score*1.1,0.05),0.9) AS thr FROM q)
SELECT zone, n, p50, p90, p99, p999, max_score, n_scans, thr, count(*) FILTER (score >= thr) AS n_thr, count(*) FILTER (score >= 0.3) AS n_03,
  count(*) FILTER (score >= 0.6) AS n_06, count(*) FILTER (score >= thr)/n_scans AS per_scan_thr,
  count(*) FILTER (score >= 0.3)/n_scans AS per_scan_03, count(*) FILTER (score >= 0.6)/n_scans AS per_scan_06,
  n < 200 AS few, max_score > 0.5 AS high FROM t JOIN s USING (zone) GROUP BY zone, n, p50, p90, p99, p999, max_score, n_scans, thr""")
def score_threshold(spark, sf):
    s = B.observations(spark, sf).select("zone", (F.col("value") / 600.0).alias("score"),
                                         F.floor(F.col("t_us") / 3_600_000_000).alias("scan_no"))
    return calibrate.calibrate_threshold(s, BY, margin=1.1)


@query("site_density", """WITH p AS (SELECT c_custkey, (abs(c_acctbal) + 1)/100.0::DOUBLE AS px_per_cm FROM customer),
b AS (SELECT *, px_per_cm*22.0::DOUBLE AS bottle_px, px_per_cm*35.0::DOUBLE AS bag_px, px_per_cm*50.0::DOUBLE AS sack_px FROM p)
SELECT *, CASE WHEN px_per_cm*100 < 62.5 THEN 'below detection' WHEN px_per_cm*100 < 125 THEN 'detection'
  WHEN px_per_cm*100 < 250 THEN 'recognition' ELSE 'identification' END AS grade,
  CASE WHEN bottle_px >= 40 THEN 'good' WHEN bottle_px >= 25 THEN 'marginal' ELSE 'infeasible' END AS verdict,
  CASE WHEN bottle_px >= 25 AND bottle_px < 40 THEN CAST(least(greatest(round_even(2.2::DOUBLE*bottle_px/16,0)*16,32),192) AS INTEGER) ELSE 0 END AS cell_px FROM b""")
def site_density(spark, sf):
    p = B.table(spark, sf, "customer").select(
        "c_custkey", (F.abs("c_acctbal") + 1).alias("length_px"), F.lit(100.0).alias("length_cm"))
    return calibrate.site_density(p).drop("length_px", "length_cm")


@query("proposed_cell_px", """SELECT p_partkey, CAST(least(greatest(round_even(48.0::DOUBLE*(p_size*40+100)/1080/8,0)*8,24),96) AS INTEGER) AS cell_px FROM part""")
def proposed_cell_px(spark, sf):
    from zonewatch.functions.geometry import proposed_cell_px as fn
    return B.table(spark, sf, "part").select("p_partkey", fn(F.col("p_size") * 40 + 100).alias("cell_px"))


@query("tuning_mismatch", """SELECT s_suppkey, 'models/w' || s_suppkey % 5 || '.pt' AS weights, 'w' || s_nationkey % 5 || '.pt' AS tuned_for
FROM supplier WHERE s_suppkey % 5 <> s_nationkey % 5""")
def tuning_mismatch(spark, sf):
    c = B.table(spark, sf, "supplier").select(
        "s_suppkey", F.format_string("models/w%d.pt", F.col("s_suppkey") % 5).alias("weights"),
        F.format_string("w%d.pt", F.col("s_nationkey") % 5).alias("tuned_for"))
    return calibrate.check_tuning(c)
