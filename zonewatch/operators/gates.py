"""Persistence gates over ordered observations.

Windows where a window expresses the rule; a replayed step where each decision depends
on the one before (clearing, greedy cooldown, latch, mute).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewatch.operators.ordered import arrange
from zonewatch.operators.replay import replay


# --- windows ----------------------------------------------------------------------

def dwell(df: DataFrame, changed: Column, by: Sequence[str], order: Sequence[str],
          visible: Column | None = None, name: str = "run") -> DataFrame:
    """Length of the current run of changed rows.

    An unchanged visible row sets it to 0; an invisible row leaves it as it was.
    """
    visible = F.lit(True) if visible is None else visible
    grows = F.when(visible & changed, 1).otherwise(0).cast("bigint")
    resets = visible & ~changed
    return (arrange(df, by, order)
            .running({"_seen": ("sum", grows)})
            .running({"_base": ("max", F.when(resets, F.col("_seen")))})
            .with_columns({name: F.col("_seen") - F.coalesce(F.col("_base"), F.lit(0).cast("bigint"))})
            .done().drop("_seen", "_base"))


def confirm(df: DataFrame, present: Column, n: int, m: int, by, order,
            name: str = "passed") -> DataFrame:
    """At least n of the last m rows present; short histories count as they are."""
    m = max(1, m)
    n = min(max(1, n), m)
    out = arrange(df, by, order).tail({"_sum": ("sum", present.cast("int"))}, m).done()
    return out.withColumn(name, F.col("_sum") >= n).drop("_sum")


def all_absent(df: DataFrame, present: Column, m: int, by, order,
               name: str = "absent") -> DataFrame:
    out = arrange(df, by, order).tail({"_any": ("max", present.cast("int"))}, m).done()
    return out.withColumn(name, F.col("_any") == 0).drop("_any")


def persist_from(df: DataFrame, value: Column, thr: float, by, order,
                 name: str = "persists") -> DataFrame:
    """True from where every later value (this one included) stays at or above thr."""
    out = arrange(df, by, order).remaining({"_low": ("min", value)}).done()
    return out.withColumn(name, F.col("_low") >= thr).drop("_low")


def previous(df: DataFrame, exprs: dict[str, Column], by, order) -> DataFrame:
    return arrange(df, by, order).lag(exprs).done()


def every_nth(df: DataFrame, n: int, by, order, name: str = "due") -> DataFrame:
    out = arrange(df, by, order).rank("_rn").done()
    return out.withColumn(name, F.col("_rn") % n == 0).drop("_rn")


def drift_warnings(df: DataFrame, drift: Column, max_px: float, by, order,
                   every: int = 20) -> DataFrame:
    """Warn on the 1st, 21st, .. row of each stretch drifting past 3/4 of the limit."""
    out = dwell(df, drift >= 0.75 * max_px, by, order, name="drift_run")
    return out.withColumn("warn", (F.col("drift_run") % every) == 1)


# --- replayed gates ---------------------------------------------------------------

def confirm_and_clear(df: DataFrame, n: int, m: int, by, order,
                      present: str = "present") -> DataFrame:
    """N-of-M whose history is emptied when it passes."""
    m = max(1, m)
    n = min(max(1, n), m)

    def step(state, rows):
        recent = list(state or ())
        fired = []
        for p in rows[present].tolist():
            recent = [*recent, bool(p)][-m:]
            ok = sum(recent) >= n
            fired.append(ok)
            if ok:
                recent = []
        return tuple(recent), {"fired": fired}

    return replay(df, by, order, step, "fired boolean")


def spaced(df: DataFrame, gap: int | float, by, order, time: str,
           name: str = "passed", eps: float = 0) -> DataFrame:
    """Greedy spacing: a row passes when `gap` or more has gone by since the last pass."""

    def step(state, rows):
        t = rows[time]
        ok = np.zeros(len(t), dtype=bool)
        i = 0 if state is None else int(np.searchsorted(t, state + gap - eps, side="left"))
        while i < len(t):
            ok[i], state = True, t[i].item()
            i = max(i + 1, int(np.searchsorted(t, state + gap - eps, side="left")))
        return state, {name: ok}

    return replay(df, by, order, step, f"{name} boolean")


def cooldown(df: DataFrame, seconds: float, by, order, time_us: str = "t_us") -> DataFrame:
    """De-duplication: the first row always passes, later ones once the window is over."""
    return spaced(df, int(seconds * 1_000_000), by, order, time_us)


def sample_interval(df: DataFrame, interval_s: float, by, order, time_us: str = "t_us",
                    eps_us: int = 1) -> DataFrame:
    """Rows emitted at least one interval after the row emitted before (not buckets)."""
    return (spaced(df, int(interval_s * 1_000_000), by, order, time_us, "_emit", eps_us)
            .filter("_emit").drop("_emit"))


def sample_stride(df: DataFrame, k: int, by, order, offset: int = 0,
                  limit: int | None = None) -> DataFrame:
    """Every k-th row of a key, at most `limit` of them when a limit is asked for."""
    out = arrange(df, by, order).rank("_rn").done()
    out = out.filter((F.col("_rn") > offset) & ((F.col("_rn") - 1 - offset) % k == 0))
    if limit is not None:
        out = out.filter((F.col("_rn") - 1 - offset) / k < limit)
    return out.drop("_rn")


def clutter_mask(df: DataFrame, by, order, dirty: str = "dirty", min_scans: int = 14_400,
                 mute_ratio: float = 0.98, unmute_after: int = 20,
                 control: str | None = None) -> DataFrame:
    """Mute cells that are dirty nearly always; unmute and forget after a clean streak.

    Rows whose `control` column is 'unmute' or 'reset' clear the cell instead of counting.
    """

    def step(state, rows):
        total, litter, streak, muted = state or (0, 0, 0, False)
        n = len(rows[dirty])
        orders = rows[control].tolist() if control else [None] * n
        out = {"total": [], "litter": [], "clean_streak": [], "muted": []}
        for d, ctl in zip(rows[dirty].tolist(), orders):
            if ctl in ("unmute", "reset"):
                total, litter, streak, muted = 0, 0, 0, False
            else:
                total, litter, streak = total + 1, litter + bool(d), 0 if d else streak + 1
                if muted and streak >= unmute_after:
                    total, litter, streak, muted = 0, 0, 0, False
                elif not muted:
                    muted = total >= min_scans and litter / total >= mute_ratio
            for name, v in zip(out, (total, litter, streak, muted)):
                out[name].append(v)
        return (total, litter, streak, muted), out

    return replay(df, by, order, step,
                  "total bigint, litter bigint, clean_streak bigint, muted boolean")


# --- latch ------------------------------------------------------------------------

def latch_step(state: dict | None, now: float, hot: set, *, mode: str = "latch",
               min_hot: int = 1, merge_radius: int = 2, rearm_scans: int = 4,
               n: int = 4, m: int = 6, cooldown_s: float = 1800.0) -> tuple[dict, dict]:
    """One scan of the alert decision. `hot` is a set of (row, col)."""
    s = state or {"latched": frozenset(), "recent": (), "last": None, "clean": 0}
    latched, recent, last = set(s["latched"]), list(s["recent"]), s["last"]
    if latched:
        # growth is judged against the latch as it was before this scan
        around = range(-merge_radius, merge_radius + 1)
        near = {h for h in hot if any((h[0] + i, h[1] + j) in latched for i in around for j in around)}
        latched |= near
    fresh = hot - latched
    trigger = len(fresh) >= min_hot if mode == "latch" else len(hot) >= min_hot
    recent = [*recent, trigger][-max(1, m):]
    alert = escalated = rearmed = False
    if sum(recent) >= min(max(1, n), max(1, m)):
        if mode == "latch" or last is None or now - last >= cooldown_s:
            alert, escalated = True, bool(latched)
            latched, last, recent = latched | hot, now, []
    clean = 0 if hot else s["clean"] + 1
    if latched and not hot and clean >= rearm_scans:
        latched, rearmed = set(), True
    new = {"latched": tuple(sorted(latched)), "recent": tuple(recent), "last": last, "clean": clean}
    return new, {"n_fresh": len(fresh), "alert": alert, "escalated": escalated, "rearmed": rearmed}


def latch_alerts(scans: DataFrame, by, order, time_s: str = "t_s", rows: str = "hot_rows",
                 cols: str = "hot_cols", **options) -> DataFrame:
    """Alert once per new spot; re-arm after enough scans without hot cells."""

    def step(state, cells):
        out = {"n_fresh": [], "alert": [], "escalated": [], "rearmed": []}
        for t, r, c in zip(cells[time_s], cells[rows], cells[cols]):
            hot = set(zip(np.asarray(r).tolist(), np.asarray(c).tolist()))
            state, res = latch_step(state, float(t), hot, **options)
            for k in out:
                out[k].append(res[k])
        return state, out

    return replay(scans, by, order, step,
                  "n_fresh int, alert boolean, escalated boolean, rearmed boolean")
