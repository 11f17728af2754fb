import numpy as np
import pytest

from zonewatch.operators import zone_scan as Z
from zonewatch.params import ScanParams, dwell_scans
from zonewatch.sources.readers import read_scans_stream
from zonewatch.streaming import run as R
from zonewatch.streaming import scan as SS
from zonewatch.streaming import state as ST

SIDE = 4
P = ScanParams(thr=6.0, mode="change_only", dwell=3, min_hot=1, n=1, m=1, mute_after=6, mute_ratio=0.9,
               unmute_after=2, rearm_scans=2, guard_min_visible=0.5)


def picture(level=100.0, spots=(), by=30.0):
    d = np.full((SIDE * SIDE, 64), level) + np.arange(64) / 10
    d[list(spots)] += by
    return d


def row(i, desc, hidden=(), **kw):
    keep = [k for k in range(SIDE * SIDE) if k not in hidden]
    at = np.array(keep)
    pick = {k: np.asarray(v)[at] for k, v in kw.items() if k in ("det_hit", "fine_hit", "sweep_hit", "score")}
    base = dict(t_s=30.0 * i, scan_no=i, sig="g", n_cells=SIDE * SIDE, rows=at // SIDE, cols=at % SIDE,
                desc=desc[at].ravel().astype("f4"), det_hit=None, fine_hit=None, sweep_hit=None, score=None,
                shift_px=0.0, stab_fits=None, stab_px=None, control=None)
    return {**base, **{k: v for k, v in kw.items() if k not in pick}, **pick}


def play(rows, p=P, state=None):
    out = []
    for r in rows:
        state, res = Z.zone_step(state, r, p)
        out.append(res)
    return state, out


def test_cold_start_learns_and_object_turns_hot_after_dwell():
    rows = [row(0, picture())] + [row(i, picture(spots=[5])) for i in range(1, 6)]
    _, out = play(rows)
    assert [r["n_hot"] for r in out] == [0, 0, 0, 1, 1, 1]
    assert [r["alert"] for r in out] == [False, False, False, True, False, False]
    assert out[3]["hot_rows"] == [1] and out[3]["hot_cols"] == [1]


def test_changed_cells_do_not_learn_and_calm_ones_do():
    s, _ = play([row(0, picture()), row(1, picture(spots=[5]))])
    assert s["ref"][5][0] == pytest.approx(100.0)
    s, _ = play([row(0, picture()), row(1, picture(102.0))])
    assert s["ref"][5][0] == pytest.approx(0.95 * 100 + 0.05 * 102, rel=1e-6)


def test_hidden_cells_pause():
    seq = [row(0, picture()), row(1, picture(spots=[5])), row(2, picture(spots=[5]), hidden=[5]),
           row(3, picture(spots=[5])), row(4, picture(spots=[5]))]
    _, out = play(seq)
    assert [r["n_hot"] for r in out] == [0, 0, 0, 0, 1]
    assert out[2]["n_occluded"] == 1


def test_whole_scene_change_relearns_once():
    _, out = play([row(0, picture()), row(1, picture(160.0)), row(2, picture(160.0))])
    assert [r["global_change"] for r in out] == [False, True, False]
    assert [r["n_changed"] for r in out] == [16, 16, 0]


def test_guard_needs_spread_and_visibility():
    block = [0, 1, 4, 5, 8, 9, 12, 13]  # half of the cells, but only two columns
    _, out = play([row(0, picture()), row(1, picture(spots=block))])
    assert not out[1]["global_change"]
    _, out = play([row(0, picture()), row(1, picture(160.0), hidden=range(9))])
    assert not out[1]["global_change"]


def test_shift_clears_unless_steady():
    rows = [row(0, picture()), row(1, picture(), shift_px=20.0), row(2, picture(spots=[5]))]
    s, out = play(rows)
    assert out[1]["ref_reset"] and out[2]["n_changed"] == 16 and s["known"].all()
    p = ScanParams(**{**P.__dict__, "stab_on": True})
    rows[1]["stab_fits"] = True
    assert not play(rows, p)[1][1]["ref_reset"]


def test_mute_hides_and_unmutes():
    flags = [1] * 12 + [0] * 4
    rows = [row(0, picture())] + [row(i + 1, picture(spots=[5] if f else [])) for i, f in enumerate(flags)]
    p = ScanParams(**{**P.__dict__, "mute_ratio": 0.5})
    s, out = play(rows, p)
    assert out[5]["n_hot"] == 1 and out[6]["n_hot"] == 0 and out[6]["n_muted_hit"] == 1
    assert not s["muted"].any()


def test_detector_rejects_fails_open_and_rescues():
    p = ScanParams(**{**P.__dict__, "verify_on": True, "escalate_after": 2})
    none, some = np.zeros(16, bool), np.arange(16) == 5
    hot = [row(0, picture())] + [row(i, picture(spots=[5]), det_hit=none, fine_hit=some) for i in range(1, 6)]
    _, out = play(hot, p)
    assert [r["n_hot"] for r in out] == [0, 0, 0, 0, 1, 0]
    assert out[4]["n_escalated_hot"] == 1 and out[3]["n_verify_dropped"] == 1
    broken = [row(0, picture())] + [row(i, picture(spots=[5])) for i in range(1, 4)]
    _, out = play(broken, p)
    assert out[3]["verify_failed"] and out[3]["n_hot"] == 1


def test_absorbed_object_is_found_by_the_sweep():
    """A reset while an object lies in the zone must not swallow it."""
    p = ScanParams(**{**P.__dict__, "verify_on": True})
    seen = np.arange(16) == 5
    rows = [row(0, picture(spots=[5])), row(1, picture(spots=[5]), control="reset", sweep_hit=seen, det_hit=seen)]
    rows += [row(i, picture(spots=[5]), sweep_hit=seen, det_hit=seen) for i in range(2, 6)]
    _, out = play(rows, p)
    assert any(r["n_sweep_hot"] == 1 and r["alert"] for r in out)


def test_new_grid_forgets_cells_and_late_rows_change_nothing():
    rows = [row(0, picture()), row(1, picture(spots=[5])), row(2, picture(spots=[5]), sig="other")]
    s, out = play(rows)
    assert s["sig"] == "other" and out[2]["n_changed"] == 16 and s["resweep"] == P.dwell
    s2, late = Z.zone_step(s, row(1, picture(170.0)), P)
    assert late["late"] and s2 is s


def test_classifier_mode_caps_scores_and_learns_clean():
    p = ScanParams(thr=6.0, mode="classifier", litter_thr=0.6, max_score=3, n=1, m=1)
    score = np.where(np.arange(16) == 1, 0.9, 0.1)
    s, out = play([row(0, picture(), score=score)], p)
    assert (out[0]["n_changed"], out[0]["n_dropped"], out[0]["n_scored"], out[0]["n_hot"]) == (16, 13, 3, 1)
    assert s["known"].sum() == 2  # the two clean ones of the three asked


def test_params_from_config():
    p = ScanParams.from_config({"decide": {"mode": "change_only", "dwell_scans": 3}, "confirm": {"n": 1, "m": 1}})
    assert (p.mode, p.dwell, p.n, p.m, p.thr) == ("change_only", 3, 1, 1, 6.0)
    assert dwell_scans(90, 30) == 3 and dwell_scans(91, 30) == 4


def spark_scans(spark, cameras=3, scans=12):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(cameras):
        for i in range(scans):
            spots = [5] if 3 <= i < 9 else []
            d = picture(100 + (40 if i == 10 and c == 1 else 0), spots) + rng.normal(0, .5, (16, 1))
            hit = (np.arange(16) % 2 == 1).tolist()
            for k in range(16):
                rows.append((f"c{c}", "z", "g", i, 30.0 * i, k // SIDE, k % SIDE, [float(v) for v in d[k]],
                             not (i == 4 and k == 5), hit[k], hit[k]))
    cells = spark.createDataFrame(rows, "camera_id string, zone_id string, sig string, scan_no bigint, t_s double, "
                                        "row int, col int, desc array<float>, visible boolean, det_hit boolean, sweep_hit boolean")
    return Z.pack_scans(cells, ["camera_id", "zone_id", "sig", "scan_no", "t_s"])


def table(df):
    names = ["camera_id", "scan_no", "n_hot", "n_changed", "alert", "global_change", "n_occluded", "max_run", "hot_cols"]
    return sorted(tuple(str(r[n]) for n in names) for r in df.collect())


def test_batch_sliced_batch_stream_and_resumed_stream_agree(spark, request):
    p = ScanParams(**{**P.__dict__, "verify_on": True})
    scans = Z.complete_scans(spark_scans(spark)).persist()
    batch = table(Z.scan_batch(scans, p))
    assert any(r[4] == "True" for r in batch) and any(r[5] == "True" for r in batch)
    path = R.stage_input(scans, 3, ["scan_no", "camera_id"], ["camera_id"])
    assert table(R.run_available(SS.scan_stream(read_scans_stream(spark, path), p))) == batch

    half = R.stage_input(scans.filter("scan_no >= 6"), 2, ["scan_no", "camera_id"], ["camera_id"])
    saved = R.stage_input(spark_scans(spark).limit(1), 1, ["scan_no"], ["camera_id"]) + "-state"
    ST.save_state(ST.final_states(scans.filter("scan_no < 6"), p), saved)
    grids = scans.select("camera_id", "zone_id", "sig").distinct()
    initial = ST.load_state(spark, saved, grids)
    assert initial.count() == 3 and ST.load_state(spark, saved + "-missing").count() == 0
    assert ST.load_state(spark, saved, grids.selectExpr("camera_id", "zone_id", "'new' sig")).count() == 0
    resumed = table(R.run_available(SS.scan_stream(read_scans_stream(spark, half), p, initial=initial)))
    assert resumed == [r for r in batch if int(r[1]) >= 6]

    from zonewatch.session import DEFAULT_HOT_ROWS, HOT_ROWS_CONF
    spark.conf.set(HOT_ROWS_CONF, "5")
    try:
        assert table(Z.scan_batch(scans, p)) == batch
    finally:
        spark.conf.set(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS))


def test_control_orders_reach_the_next_scan(spark):
    scans = spark.createDataFrame([("c", "z", i, 30.0 * i) for i in range(5)], "camera_id string, zone_id string, scan_no bigint, t_s double")
    orders = spark.createDataFrame([("c", "z", 45.0, "reset")], "camera_id string, zone_id string, t_s double, order string")
    got = {r.scan_no: r.control for r in Z.with_control(scans.withColumn("control", scans.zone_id), orders).collect()}
    assert got == {0: None, 1: None, 2: "reset", 3: None, 4: None}
