"""The zone scan: one step per scan of one zone, shared by batch and streaming.

What a join or an expression can decide is decided before the step (which cells are
visible, which are touched by a detection, whether the movement estimate fits). The step
keeps only what depends on earlier scans: references, runs, mutes, rejections, the
sweep countdown and the latch. Inside a step the cells of the zone are numpy vectors.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewatch import schemas
from zonewatch.functions.descriptors import TOP
from zonewatch.operators.gates import latch_step
from zonewatch.operators.ordered import arrange
from zonewatch.operators.replay import replay
from zonewatch.params import ScanParams

KEY = ["camera_id", "zone_id"]
_EMPTY = {f.name: {"boolean": False, "double": 0.0}.get(f.dataType.typeName(), 0)
          for f in schemas.SCAN_RESULT.fields}
COUNTERS = ("run", "total", "litter", "streak", "reject", "sweep")
FLAGS = ("known", "muted")


def change_scores(desc: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Mean of the largest absolute differences of each row."""
    d = np.abs(desc - ref)
    k = min(TOP, d.shape[1])
    return np.sort(d, axis=1)[:, ::-1][:, :k].sum(axis=1) / k


def _fresh_state(sig: str, width: int) -> dict:
    s = {"sig": sig, "ids": np.empty(0, np.int64), "ref": np.empty((0, width)), "resweep": 0,
         "anchor": False, "age": 0, "latch": None, "last_t": None}
    s.update({c: np.empty(0, np.int64) for c in COUNTERS})
    s.update({c: np.empty(0, bool) for c in FLAGS})
    return s


def _locate(s: dict, ids: np.ndarray) -> np.ndarray:
    """Positions of the cells in the state, adding unseen ones; ids stay sorted."""
    merged = np.union1d(s["ids"], ids)
    if len(merged) != len(s["ids"]):
        at = np.searchsorted(merged, s["ids"])
        for c in (*COUNTERS, *FLAGS, "ref"):
            old = s[c]
            new = np.zeros((len(merged), *old.shape[1:]), old.dtype)
            new[at] = old
            s[c] = new
        s["ids"] = merged
    return np.searchsorted(s["ids"], ids)


def _arm_sweep(s: dict, p: ScanParams) -> None:
    s["resweep"] = max(1, p.dwell)
    s["sweep"][:] = 0


def _forget_confirm(s: dict) -> None:
    if s["latch"]:
        s["latch"] = {**s["latch"], "recent": ()}


def _count_clutter(s: dict, at: np.ndarray, dirty: np.ndarray, p: ScanParams) -> None:
    """One clutter observation for each given cell."""
    total = s["total"][at] + 1
    litter = s["litter"][at] + dirty
    streak = np.where(dirty, 0, s["streak"][at] + 1)
    was = s["muted"][at]
    wipe = was & (streak >= p.unmute_after)
    now = was | ((total >= p.mute_after) & (litter / total >= p.mute_ratio))
    s["total"][at], s["litter"][at] = np.where(wipe, 0, total), np.where(wipe, 0, litter)
    s["streak"][at], s["muted"][at] = np.where(wipe, 0, streak), now & ~wipe


def _learn(s: dict, at: np.ndarray, desc: np.ndarray, alpha: float) -> None:
    """Blend into the reference, or copy where there is none."""
    known = s["known"][at][:, None]
    s["ref"][at] = np.where(known, (1 - alpha) * s["ref"][at] + alpha * desc, desc)
    s["known"][at] = True


def _progress(s: dict, p: ScanParams) -> float:
    if not p.clutter_on:
        return 1.0
    return min(1.0, float(s["total"].max(initial=0)) / max(1, p.mute_after))


def _control(s: dict, order: str, p: ScanParams) -> None:
    if order.startswith("unmute:"):
        r, c = (int(v) for v in order[7:].split(","))
        at = np.flatnonzero(s["ids"] == (r << 32 | c))
        s["total"][at] = s["litter"][at] = s["streak"][at] = 0
        s["muted"][at] = False
        return
    s["known"][:] = False
    s["run"][:] = s["reject"][:] = 0
    s["anchor"] = False
    if s["latch"]:
        s["latch"] = {**s["latch"], "latched": (), "recent": (), "clean": 0}
    _arm_sweep(s, p)
    if order == "reset_all":
        s["total"][:] = s["litter"][:] = s["streak"][:] = 0
        s["muted"][:] = False


def _whole_scene_changed(rows, cols, known, changed, n_cells: int, p: ScanParams) -> bool:
    hit = known & changed
    n_known, n_hit = int(known.sum()), int(hit.sum())
    if not n_hit or n_known < max(8, p.guard_min_visible * n_cells) or n_hit < p.guard_frac * n_known:
        return False
    share = min(len(np.unique(v[hit])) / len(np.unique(v[known])) for v in (rows, cols))
    return share >= p.guard_spread


def _boxes(given) -> list[list[float]]:
    """Boxes of a scan's row as plain lists."""
    return [[float(v) for v in b] for b in given] if given is not None else []


def _verify(s: dict, at: np.ndarray, hot: np.ndarray, row: dict, res: dict, p: ScanParams) -> np.ndarray:
    """Keep hot cells the detector confirms; look closer where it keeps refusing."""
    if not p.verify_on or not hot.any():
        return hot
    if row["det_hit"] is None:
        res["verify_failed"] = True
        return hot
    res["verify_boxes"] = _boxes(row.get("det_boxes"))
    res["verify_conf"] = max((b[4] for b in res["verify_boxes"]), default=0.0)
    keep = hot & np.asarray(row["det_hit"], bool)
    dropped = hot & ~keep
    res["n_verify_dropped"] = int(dropped.sum())
    s["reject"][at[keep]] = 0
    s["reject"][at[dropped]] += 1
    if p.escalate_after and row["fine_hit"] is not None:
        again = dropped & (s["reject"][at] >= p.escalate_after) & np.asarray(row["fine_hit"], bool)
        s["reject"][at[again]] = 0
        res["n_escalated_hot"] = int(again.sum())
        if again.any():
            res["verify_boxes"] = res["verify_boxes"] + _boxes(row.get("fine_boxes"))
        keep = keep | again
    return keep


def _sweep(s: dict, at: np.ndarray, hot: np.ndarray, row: dict, res: dict, p: ScanParams) -> np.ndarray:
    """After a lost background, cells the detector sees scan after scan become hot."""
    if s["resweep"] <= 0 or not p.verify_on:
        return hot
    s["resweep"] -= 1
    if row["sweep_hit"] is None:
        return hot
    s["sweep"][at] = np.where(np.asarray(row["sweep_hit"], bool), s["sweep"][at] + 1, 0)
    muted = s["muted"][at] if p.clutter_on else False
    add = (s["sweep"][at] >= p.dwell) & ~hot & ~muted
    res["n_sweep_hot"] = int(add.sum())
    if add.any():
        res["verify_boxes"] = res["verify_boxes"] + _boxes(row.get("sweep_boxes"))
    return hot | add


def _change_only(s, at, desc, changed, known, row, res, p) -> np.ndarray:
    """Decide by persistence alone: a cell is hot after `dwell` changed scans in a row."""
    first = ~known if p.change_on else np.zeros(len(at), bool)
    grows = changed & ~first
    s["run"][at] = np.where(grows, s["run"][at] + 1, 0)
    calm = at[~grows]
    if p.change_on and len(calm):
        _learn(s, calm, desc[~grows], p.alpha)
    raw = (s["run"][at] >= p.dwell) & ~first
    if p.clutter_on:
        counted = ~first & (changed | s["muted"][at])
        _count_clutter(s, at[counted], (raw & changed)[counted], p)
    muted = s["muted"][at] if p.clutter_on else np.zeros(len(at), bool)
    res.update(n_raw_hot=int(raw.sum()), n_muted_hit=int((raw & muted).sum()), n_scored=len(at),
               max_run=int(s["run"].max(initial=0)))
    hot = _verify(s, at, raw & ~muted, row, res, p)
    return _sweep(s, at, hot, row, res, p)


def _classifier(s, at, ids, desc, score, changed, row, res, p) -> np.ndarray:
    """Decide by the classifier's score of the strongest changed cells."""
    cand = np.flatnonzero(changed)
    cand = cand[np.lexsort((ids[cand], -score[cand]))]
    if 0 < p.max_score < len(cand):
        res["n_dropped"] = len(cand) - p.max_score
        cand = cand[:p.max_score]
    given = np.asarray(row["score"], float) if row["score"] is not None else np.zeros(len(at))
    raw = given[cand] >= p.litter_thr
    if p.clutter_on:
        _count_clutter(s, at[cand], raw, p)
    muted = s["muted"][at[cand]] if p.clutter_on else np.zeros(len(cand), bool)
    learns = ~raw | muted
    if p.change_on and learns.any():
        _learn(s, at[cand[learns]], desc[cand[learns]], p.alpha)
    res.update(n_raw_hot=int(raw.sum()), n_muted_hit=int((raw & muted).sum()), n_scored=len(cand))
    hot = np.zeros(len(at), bool)
    hot[cand[raw & ~muted]] = True
    return _verify(s, at, hot, row, res, p)


def zone_step(state: dict | None, row: dict, p: ScanParams) -> tuple[dict | None, dict]:
    """One scan: (state, input row) -> (state, result row)."""
    res = {**_EMPTY, "hot_rows": [], "hot_cols": [], "verify_boxes": []}
    t, order = float(row["t_s"]), row["control"]
    if order == "remove":
        return None, res
    if state is not None and state["last_t"] is not None and t <= state["last_t"]:
        res["late"] = True
        return state, res

    desc = np.asarray(row["desc"], float)
    rows, cols = np.asarray(row["rows"], np.int64), np.asarray(row["cols"], np.int64)
    desc = desc.reshape(len(rows), -1) if len(rows) else np.empty((0, 64))
    s = state or _fresh_state(row["sig"], desc.shape[1])
    if s["sig"] != row["sig"]:  # another grid: cell numbers mean something else now
        kept = {k: s[k] for k in ("anchor", "age", "latch")}
        s = {**_fresh_state(row["sig"], desc.shape[1]), **kept}
        if s["latch"]:
            s["latch"] = {**s["latch"], "latched": ()}
        _arm_sweep(s, p)
    else:
        s = {k: v.copy() if isinstance(v, np.ndarray) else v for k, v in s.items()}
    s["last_t"] = t
    if order:
        _control(s, order, p)
    n_cells = int(row["n_cells"])
    res["mask_progress"] = _progress(s, p)
    if not n_cells:
        return s, res

    steady = False
    if p.stab_on:
        steady, s["anchor"] = bool(s["anchor"] and row["stab_fits"]), True
    if (row["shift_px"] or 0.0) >= p.shift_thr and not steady:
        for c in ("known", "muted", "run", "total", "litter", "streak"):
            s[c][:] = 0
        s["anchor"] = False
        _forget_confirm(s)
        _arm_sweep(s, p)
        res["ref_reset"] = True
        return s, res

    ids = rows << 32 | cols
    at = _locate(s, ids)
    known = s["known"][at]
    score = np.full(len(at), np.inf)
    if p.change_on and known.any():
        score[known] = change_scores(desc[known], s["ref"][at[known]])
    changed = score >= p.thr
    seen = score[np.isfinite(score)]
    res.update(n_occluded=n_cells - len(at), n_changed=int(changed.sum()),
               max_change=float(seen.max()) if len(seen) else 0.0)

    if p.change_on and _whole_scene_changed(rows, cols, known, changed, n_cells, p):
        s["ref"][at], s["known"][at], s["run"][at] = desc, True, 0
        s["anchor"] = False
        _arm_sweep(s, p)
        latch = s["latch"] or {"latched": (), "recent": (), "last": None, "clean": 0}
        s["latch"] = {**latch, "recent": (*latch["recent"], False)[-max(1, p.m):]}
        res["global_change"] = True
        return s, res

    if p.mode == "change_only":
        hot = _change_only(s, at, desc, changed, known, row, res, p)
    else:
        if p.change_on and p.assume_clean_start and not s["known"].any() and len(at):
            _learn(s, at, desc, p.alpha)
            return s, res
        hot = _classifier(s, at, ids, desc, score, changed, row, res, p)

    spots = set(zip(rows[hot].tolist(), cols[hot].tolist()))
    s["latch"], decided = latch_step(
        s["latch"], t, spots, mode=p.alert_mode, min_hot=p.min_hot, merge_radius=p.merge_radius,
        rearm_scans=p.rearm_scans, n=p.n, m=p.m, cooldown_s=p.cooldown_s)
    res.update(decided, n_hot=len(spots), dirty=len(spots) >= p.min_hot, mask_progress=_progress(s, p),
               hot_rows=rows[hot].tolist(), hot_cols=cols[hot].tolist())
    if p.stab_on:
        s["age"] += 1
        calm = res["n_changed"] <= max(2, 0.05 * max(1, n_cells))
        if s["age"] >= p.anchor_refresh and calm and not spots and s["resweep"] <= 0 and steady:
            s["age"], res["anchor_refreshed"] = 0, True
    return s, res


# --- batch --------------------------------------------------------------------------

def complete_scans(scans: DataFrame) -> DataFrame:
    """Fill optional input columns so that one schema serves batch and stream."""
    have = set(scans.columns)
    return scans.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have
                          else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.SCANS.fields])


def scan_batch(scans: DataFrame, params: ScanParams) -> DataFrame:
    """Run the zone scan over stored scans, one row out per row in."""

    def step(state, cols):
        out = {f.name: [] for f in schemas.SCAN_RESULT.fields}
        names = list(cols)
        for values in zip(*cols.values()):
            state, res = zone_step(state, clean_row(dict(zip(names, values))), params)
            for k, v in res.items():
                out[k].append(v)
        return state, out

    return replay(complete_scans(scans), KEY, ["t_s", "scan_no"], step, schemas.SCAN_RESULT,
                  keep=[*KEY, "scan_no", "t_s", "sig", "n_cells"])


def clean_row(row: dict) -> dict:
    """NULLs come out of Arrow as NaN in scalar columns; make them None again."""
    for k in ("control", "shift_px", "stab_fits", "stab_px", "score", "det_hit", "fine_hit", "sweep_hit",
              "det_boxes", "fine_boxes", "sweep_boxes"):
        v = row[k]
        if v is not None and np.isscalar(v) and not isinstance(v, str) and v != v:
            row[k] = None
    return row


def pack_scans(cells: DataFrame, by: list[str], extra: list[str] = ()) -> DataFrame:
    """Cell observations to one row per scan. A scan holds at most the cells of one grid.

    `cells` has row, col, visible, desc and optionally det_hit, fine_hit, sweep_hit, score.
    """
    optional = [c for c in ("det_hit", "fine_hit", "sweep_hit", "score") if c in cells.columns]
    item = F.struct("row", "col", "desc", *optional)
    packed = cells.groupBy(*by, *extra).agg(
        F.count(F.lit(1)).cast("int").alias("n_cells"),
        F.sort_array(F.collect_list(F.when(F.col("visible"), item))).alias("_c"))
    c = F.col("_c")
    cols = {"rows": c["row"], "cols": c["col"], "desc": F.flatten(c["desc"])}
    cols.update({o: c[o] for o in optional})
    return packed.withColumns(cols).drop("_c")


def with_control(scans: DataFrame, control: DataFrame, by=KEY) -> DataFrame:
    """Attach each control order to the first scan at or after it.

    control: keys, t_s, order. With several orders before one scan the last one counts, of one time the
    greatest text. Orders and scans of a key stand in one time line; each scan ends a stretch of it.
    """
    by, plain = list(by), scans.drop("control")
    scan = plain.select(*by, "t_s", F.struct(*plain.columns).alias("_scan"), F.lit(1).alias("_is"), F.col("scan_no").alias("_tie"))
    rows = scan.unionByName(control.select(*by, "t_s", "order", F.lit(0).alias("_is")), allowMissingColumns=True)
    line = arrange(rows, by, ["t_s", "_is", "_tie"]).running({"_scans": ("sum", F.col("_is"))}).done()
    stretch = line.withColumn("_nth", F.col("_scans") - F.col("_is")).groupBy(*by, "_nth").agg(
        F.max_by("_scan", "_is").alias("s"), F.max_by("order", F.when(F.col("_is") == 0, F.struct("t_s", "order"))).alias("control"))
    return stretch.filter("s IS NOT NULL").select("s.*", "control")


def stabilise_policy(dx: Column, dy: Column, deg: Column, fdx: Column, fdy: Column, fdeg: Column,
                     w: Column, h: Column, p: ScanParams) -> tuple[Column, Column, Column]:
    """(fits, distance, warp) for a movement estimate in full-resolution pixels.

    A coarse estimate out of range does not fit. From stab_fine_px on, a valid fine estimate
    replaces it. Small total displacement needs no warp.
    """
    d0, d1 = F.hypot(dx, dy), F.hypot(fdx, fdy)
    fits = F.coalesce((d0 <= p.stab_max_px) & (F.abs(deg) <= p.stab_max_deg), F.lit(False))
    fine = F.coalesce((d0 >= p.stab_fine_px) & (d1 <= p.stab_max_px) & (F.abs(fdeg) <= p.stab_max_deg), F.lit(False))
    d, a = F.when(fine, d1).otherwise(d0), F.when(fine, fdeg).otherwise(deg)
    corner = d + F.abs(F.sin(F.radians(a))) * F.hypot(w, h) / 2
    return fits, F.when(fits, d).otherwise(F.lit(0.0)), fits & (corner >= p.stab_min_px)


def gated_reference(obs: DataFrame, by: list[str], order: list[str], thr: float, alpha: float,
                    desc: str = "desc") -> DataFrame:
    """Change gate of single cells (no guard): score, changed and run, keyed per cell.

    Without the guard cells do not influence each other, so each one is its own key.
    """

    def step(state, cols):
        ref, run = state if state is not None else (None, 0)
        out = {"score": [], "changed": [], "run": []}
        for d in cols[desc]:
            d = np.asarray(d, float)
            s = 0.0 if ref is None else float(change_scores(d[None], ref[None])[0])
            hit = ref is not None and s >= thr
            run = run + 1 if hit else 0
            if not hit:
                ref = d if ref is None else (1 - alpha) * ref + alpha * d
            for k, v in zip(out, (s, hit, run)):
                out[k].append(v)
        return (ref, run), out

    return replay(obs, by, order, step, "score double, changed boolean, run bigint",
                  keep=[*by, *order])


__all__ = ["zone_step", "scan_batch", "complete_scans", "pack_scans", "with_control", "stabilise_policy",
           "gated_reference"]
