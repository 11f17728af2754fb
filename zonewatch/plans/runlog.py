"""Reports over scan logs: summaries, bins, events against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewatch.functions.grading import rate_per_day, rate_verdict
from zonewatch.operators.ordered import arrange, indexed_values
from zonewatch.sinks.writers import hot_cells_text

SHIFT_PX = 3.0  # fixed: a scan counts as shifted from here


def stitch_segments(log: DataFrame, by: list[str], order: list[str], t: str = "t_s",
                    gap_s: float = 30.0) -> DataFrame:
    """One running time over restarts: each restart goes on `gap_s` after the last time."""
    back = F.col("_prev").isNotNull() & (F.col(t) < F.col("_prev"))
    shift = F.when(back, F.col("_prev") + gap_s).otherwise(F.lit(0.0))
    return (arrange(log, by, order).lag({"_prev": F.col(t)})
            .with_columns({"_jump": shift, "_new": back.cast("int")})
            .running({"_off": ("sum", F.col("_jump")), "segment": ("sum", F.col("_new"))})
            .done().withColumn("t_run", F.col(t) + F.col("_off"))
            .drop("_prev", "_jump", "_new", "_off"))


def scan_log(results: DataFrame, scans: DataFrame, by: list[str], boxes: DataFrame | None = None,
             ms: DataFrame | None = None) -> DataFrame:
    """The results of a zone scan as a log that the reports below can read: all log columns.

    `scans` are the scans that went in (shift_px, stab_px and, if there, stab_deg are theirs), `boxes` the
    detections (by.., conf) and `ms` the durations (by.., ms) of single scans, where there are any. `by`
    names one scan. Without `boxes`, those count that went through the scan itself.
    """
    given = scans.select(*by, *[(F.col(c) if c in scans.columns else F.lit(None)).cast("double").alias(c)
                                for c in ("shift_px", "stab_px", "stab_deg")])
    log = results.join(given, by, "left")
    if boxes is not None:
        log = log.drop("verify_conf")
        seen = boxes.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n_verify_boxes"), F.max("conf").alias("verify_conf"))
        log = log.join(seen, by, "left").withColumn("n_verify_boxes", F.coalesce("n_verify_boxes", F.lit(0)))
    else:
        log = log.withColumn("n_verify_boxes", F.size("verify_boxes"))
    log = log.join(ms, by, "left") if ms is not None else log.withColumn("ms", F.lit(None).cast("double"))
    notes = F.concat_ws("; ", F.when(F.col("late"), "late"), F.when(F.col("global_change"), "whole scene changed"),
                        F.when(F.col("ref_reset"), "references reset"), F.when(F.col("verify_failed"), "detector failed"))
    return log.withColumns({"hot_cells": hot_cells_text(F.col("hot_rows"), F.col("hot_cols")), "notes": notes})


def run_summary(log: DataFrame, by: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return log.groupBy(*by).agg(
        (F.max("t_s") - F.min("t_s")).alias("span_s"), n.alias("n_scans"),
        F.count_if("dirty").alias("n_dirty"), (100.0 * F.count_if("dirty") / n).alias("dirty_pct"),
        F.count_if("alert").alias("n_alerts"), F.sum("n_dropped").alias("n_dropped"),
        F.count_if(F.col("shift_px") >= SHIFT_PX).alias("n_shifted"),
        F.count_if(F.col("n_hot") > 0).alias("n_with_hot"), F.avg("n_changed").alias("mean_changed"),
        F.max_by("mask_progress", "t_s").alias("last_progress"))


def false_alarms(log: DataFrame, by: list[str]) -> DataFrame:
    """Alerts of a clean run as a daily rate, unless the run is too short."""
    s = run_summary(log, by).withColumn("hours", F.col("span_s") / 3600.0)
    rate = rate_per_day(F.col("n_alerts"), F.col("hours"))
    return s.select(*by, "n_alerts", "hours", rate.alias("per_day"), rate_verdict(rate).alias("verdict"))


def clean_time(truth: DataFrame, log: DataFrame, by: list[str]) -> DataFrame:
    """Observed seconds outside the truth intervals (overlaps count twice, at least 1e-9)."""
    span = log.groupBy(*by).agg(F.min("t_s").alias("t0"), F.max("t_s").alias("t1"))
    part = F.least("b", "t1") - F.greatest("a", "t0")
    busy = truth.join(span, by).groupBy(*by).agg(F.sum(part).alias("busy"))
    return span.join(busy, by, "left").select(
        *by, F.greatest(F.lit(1e-9), F.col("t1") - F.col("t0") - F.coalesce("busy", F.lit(0.0))).alias("clean_s"))


def _timeline(alerts: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Interval starts, alerts and interval ends on one line; ties in that order."""
    a = alerts.select(*by, F.col("t_s").alias("t"), F.lit(1).alias("kind"), F.lit(0).alias("step"),
                      F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("double").alias("b"))
    starts = truth.select(*by, F.col("a").alias("t"), F.lit(0).alias("kind"), F.lit(1).alias("step"),
                          "event_id", "b")
    ends = truth.select(*by, F.col("b").alias("t"), F.lit(2).alias("kind"), F.lit(-1).alias("step"),
                        "event_id", F.lit(None).cast("double").alias("b"))
    return a.unionByName(starts).unionByName(ends)


def alerts_in_truth(alerts: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Adds `inside`: some truth interval [a, b] holds the alert.

    A running count of open intervals answers it, so no alert meets every interval.
    """
    line = arrange(_timeline(alerts, truth, by), by, ["t", "kind", "event_id"])
    out = line.running({"open": ("sum", F.col("step"))}).done().filter("kind = 1")
    return out.select(*by, F.col("t").alias("t_s"), (F.col("open") > 0).alias("inside"))


def first_alert_after(alerts: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Each event with the first alert at or after its start."""
    line = arrange(_timeline(alerts, truth, by).filter("kind < 2"), by, ["t", "kind", "event_id"])
    out = line.remaining({"t_alert": ("min", F.when(F.col("kind") == 1, F.col("t")))}).done()
    return out.filter("kind = 0").select(*by, "event_id", F.col("t").alias("a"), "b", "t_alert")


def event_latency(alerts: DataFrame, truth: DataFrame, by: list[str], grace_s: float = 180.0) -> DataFrame:
    """Events with hit and latency: the first alert in [a, b + grace]."""
    hit = F.coalesce(F.col("t_alert") <= F.col("b") + grace_s, F.lit(False))
    return (first_alert_after(alerts, truth, by).withColumn("hit", hit)
            .withColumn("latency_s", F.when(F.col("hit"), F.col("t_alert") - F.col("a"))))


def event_recall(log: DataFrame, truth: DataFrame, by: list[str], grace_s: float = 180.0) -> DataFrame:
    """Recall, upper-median and worst latency, true and false alarms, false alarms per day."""
    alerts = log.filter("alert").select(*by, "t_s")
    events = event_latency(alerts, truth, by, grace_s)
    recall = events.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"), F.count_if("hit").alias("n_hit"),
                                     F.max("latency_s").alias("worst_s"))
    middle = indexed_values(events, by, "latency_s", {"median_s": F.floor(F.col("n") / 2)}).drop("n")
    verdicts = alerts_in_truth(alerts, truth, by).groupBy(*by).agg(
        F.count_if("inside").alias("n_true"), F.count_if(~F.col("inside")).alias("n_false"))
    out = (recall.join(middle, by, "left").join(verdicts, by, "left")
           .join(clean_time(truth, log, by), by, "left"))
    zero = F.lit(0).cast("bigint")
    out = out.withColumns({"n_true": F.coalesce("n_true", zero), "n_false": F.coalesce("n_false", zero)})
    rate = rate_per_day(F.col("n_false"), F.col("clean_s") / 3600.0)
    return out.withColumn("false_per_day", rate).withColumn("verdict", rate_verdict(rate))


def post_warm_rate(log: DataFrame, by: list[str]) -> DataFrame:
    """Alert rate once the clutter mask is mature; only runs that started immature."""
    warm = log.groupBy(*by).agg(F.min(F.when(F.col("mask_progress") >= 1.0, F.col("t_s"))).alias("warm"),
                                F.min("t_s").alias("t0"), F.max("t_s").alias("t1"))
    warm = warm.filter("warm is not null and warm > t0")
    late = (log.filter("alert").join(warm, by).filter(F.col("t_s") >= F.col("warm"))
            .groupBy(*by).agg(F.count(F.lit(1)).alias("n_after")))
    out = warm.join(late, by, "left").withColumn("n_after", F.coalesce("n_after", F.lit(0).cast("bigint")))
    hours = (F.col("t1") - F.col("warm")) / 3600.0
    rate = rate_per_day(F.col("n_after"), hours)
    return out.select(*by, "warm", "n_after", hours.alias("hours"), rate.alias("per_day"),
                      rate_verdict(rate).alias("verdict"))


def time_bins(log: DataFrame, by: list[str], minutes: float = 30.0, t: str = "t_s") -> DataFrame:
    return (log.withColumn("bin", F.floor(F.col(t) / (minutes * 60)))
            .groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n_scans"), F.count_if(F.col("n_hot") > 0).alias("n_with_hot"),
        F.count_if("alert").alias("n_alerts"), F.avg("n_changed").alias("mean_changed")))


def alert_cells(log: DataFrame, by: list[str]) -> DataFrame:
    """How often each cell was hot in an alert."""
    return (log.filter("alert").withColumn("cell", F.explode(F.split("hot_cells", " ")))
            .filter("cell <> ''").groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n")))


def cell_concentration(log: DataFrame, by: list[str], share: float = 0.4) -> DataFrame:
    """Whether alerts keep coming from the same cells."""
    return alert_cells(log, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("n") >= 2).alias("n_repeated"),
        (F.count_if(F.col("n") >= 2) > share * F.count(F.lit(1))).alias("concentrated"))


def progress_resets(log: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Scans at which the mask progress fell."""
    out = arrange(log, by, order).lag({"_prev": F.col("mask_progress")}).done()
    return out.groupBy(*by).agg(F.count_if(F.col("mask_progress") < F.col("_prev") - 1e-9).alias("n_resets"))


def reject_share(log: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Detector rejections, mask maturity, resets, muted hits and mean scan time."""
    vd, vb = F.sum("n_verify_dropped"), F.sum("n_verify_boxes")
    base = log.groupBy(*by).agg(
        vd.alias("n_rejected"), vb.alias("n_boxes"),
        (100.0 * vd / F.greatest(F.lit(1), vd + vb)).alias("rejected_pct"),
        (F.count_if(F.col("mask_progress") >= 1.0) / F.count(F.lit(1))).alias("ripe_share"),
        F.sum("n_muted_hit").alias("n_muted_hit"), F.avg("ms").alias("mean_ms"))
    return base.join(progress_resets(log, by, order), by)


def first_scan_after(events: DataFrame, scans: DataFrame, by: list[str], at: str, scan_at: str,
                     scan: str, event: str = "event_id") -> DataFrame:
    """As-of join forward: each event with the first scan at or after it."""
    e = events.select(*by, F.col(at).alias("t"), F.lit(0).alias("kind"), F.col(event).alias("_e"),
                      F.lit(None).cast(scans.schema[scan].dataType).alias("scan"))
    s = scans.select(*by, F.col(scan_at).alias("t"), F.lit(1).alias("kind"),
                     F.lit(None).cast(events.schema[event].dataType).alias("_e"), F.col(scan).alias("scan"))
    line = arrange(e.unionByName(s), by, ["t", "kind", "_e", "scan"])
    first = F.when(F.col("kind") == 1, F.struct("t", "scan"))
    out = line.remaining({"_first": ("min", first)}).done().filter("kind = 0")
    return out.select(*by, F.col("_e").alias(event), F.col("t").alias(at), F.col("_first.scan").alias(scan))


# --- events against scans -----------------------------------------------------------

def latency_breakdown(scans: DataFrame, events: DataFrame, by: list[str], min_hot: int = 1,
                      scan: str = "scan_no") -> DataFrame:
    """Scans lost between an event and its alert, by cause; earlier alerts are false.

    `events` has one row per key with ev_scan. Each lost scan is not persistent enough,
    rejected by the detector, or held back by the latch.
    """
    s = scans.join(events.select(*by, "ev_scan"), by)
    after = F.col(scan) >= F.col("ev_scan")
    answers = (after & F.col("alert")).cast("int")
    # a scan waits as long as no alert has answered the event before it; scans are told in one ordered pass
    line = arrange(s.withColumn("_answer", answers), by, [scan, "_answer"]).running({"_answers": ("sum", F.col("_answer"))}).done()
    waiting = after & (F.col("_answers") - F.col("_answer") == 0)
    raw, hot = F.col("n_raw_hot") >= min_hot, F.col("n_hot") >= min_hot
    out = line.groupBy(*by).agg(
        F.max("ev_scan").alias("ev_scan"), F.min(F.when(F.col("_answer") == 1, F.col(scan))).alias("alert_scan"),
        F.min(F.when(after & raw, F.col(scan))).alias("raw_scan"), F.count_if(~after & F.col("alert")).alias("n_false"),
        F.count_if(waiting & ~raw).alias("n_not_persistent"), F.count_if(waiting & raw & ~hot).alias("n_rejected"),
        F.count_if(waiting & raw & hot & ~F.col("alert")).alias("n_held"))
    return out.withColumn("delay", F.col("alert_scan") - F.col("ev_scan"))


def event_outcome(alert_scans: DataFrame, on_target: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """on_target, elsewhere or silent for each event."""
    first_any = alert_scans.groupBy(*by).agg(F.min("scan_no").alias("first_any"))
    first_hit = on_target.groupBy(*by).agg(F.min("scan_no").alias("first_on_target"))
    out = events.join(first_any, by, "left").join(first_hit, by, "left")
    return out.withColumn("outcome", F.when(F.col("first_on_target").isNotNull(), F.lit("on_target"))
                          .when(F.col("first_any").isNotNull(), F.lit("elsewhere")).otherwise(F.lit("silent")))


def first_alert_scan(results: DataFrame, by: list[str], intervals: list[int]) -> DataFrame:
    """Delay in scans and minutes at several cadences; NULL without an alert."""
    delay = results.groupBy(*by).agg(
        (F.min(F.when(F.col("alert") & (F.col("scan_no") >= F.col("ev_scan")), F.col("scan_no")))
         - F.min("ev_scan")).alias("delay_scans"))
    rows = delay.withColumn("interval_s", F.explode(F.array(*[F.lit(i) for i in intervals])))
    minutes = F.col("delay_scans") * F.col("interval_s") / 60.0
    return rows.withColumn("minutes", minutes).withColumn("late", F.coalesce(minutes > 3.0, F.lit(True)))


def sweep_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Per setting: changed share of the first scan, guard, shift and alert scans."""
    return results.groupBy(*by).agg(
        F.min_by(100.0 * F.col("n_changed") / F.greatest(F.lit(1), F.col("n_cells")), "scan_no").alias("first_changed_pct"),
        F.count_if("global_change").alias("n_guard"), F.count_if("ref_reset").alias("n_shift"),
        F.count_if("alert").alias("n_alerts"))


def scenario_summary(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(
        F.max("n_hot").alias("max_hot"), F.count_if("ref_reset").alias("n_reset"),
        F.count_if("global_change").alias("n_guard"), (F.max("n_hot") > 0).alias("passed"))


def negative_yield(negatives: DataFrame, scans: DataFrame, by: list[str]) -> DataFrame:
    n = negatives.groupBy(*by).agg(F.count(F.lit(1)).alias("n_crops"))
    s = scans.groupBy(*by).agg(F.count(F.lit(1)).alias("n_scans"))
    z = F.lit(0).cast("bigint")
    return (s.join(n, by, "left").withColumn("n_crops", F.coalesce("n_crops", z))
            .withColumn("per_scan", F.col("n_crops") / F.greatest(F.lit(1), "n_scans")))


def alert_sessions(scans: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Alert episodes: from the first alert while the zone is armed to the scan that re-arms it.

    Escalated alerts start no episode but belong to the one that is open. An episode that nothing
    re-arms is open to the end and has no t_end.
    """
    opens, closes = F.col("alert") & ~F.col("escalated"), F.col("rearmed")
    # between two re-arming scans lies at most one episode; the re-arming scan is the last of its stretch
    out = (arrange(scans.withColumns({"_close": closes.cast("int"), "_open": opens.cast("int")}), by, order)
           .running({"_closed": ("sum", F.col("_close"))}).done())
    out = out.withColumn("_stretch", F.col("_closed") - F.col("_close"))
    out = arrange(out, [*by, "_stretch"], order).running({"_opened": ("sum", F.col("_open"))}).done().filter("_opened > 0")
    rows = out.groupBy(*by, "_stretch").agg(
        F.min("t_s").alias("t_start"), F.max(F.when(closes, F.col("t_s"))).alias("t_end"),
        F.count_if("alert").alias("n_alerts"), F.max("n_hot").alias("max_hot"))
    return arrange(rows, by, ["_stretch"]).rank("episode").done().drop("_stretch")


def latest_status(scans: DataFrame, by: list[str], order: str = "scan_no") -> DataFrame:
    """Latest scan of each zone, as one aggregate."""
    rest = [c for c in scans.columns if c not in by and c != order]
    return (scans.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("s"),
                                   F.max(order).alias(order)).select(*by, order, "s.*"))
