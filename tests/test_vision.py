import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_zone_scan import P, picture, row

from zonewatch.functions.tables import register_tables
from zonewatch.operators import grid as GR
from zonewatch.operators import pixels as PX
from zonewatch.operators import zone_scan as Z
from zonewatch.params import ScanParams
from zonewatch.plans import calibrate

VERIFYING = ScanParams(**{**P.__dict__, "verify_on": True, "escalate_after": 2})


def play(rows, p):
    state, out = None, []
    for r in rows:
        state, res = Z.zone_step(state, r, p)
        out.append(res)
    return out


def test_boxes_of_each_look_are_appended():
    none, hit = [False] * 16, [i == 5 for i in range(16)]
    box = lambda conf: [[0.0, 0.0, 9.0, 9.0, conf]]
    seen = dict(det_hit=none, fine_hit=hit, sweep_hit=none, det_boxes=box(0.4), fine_boxes=box(0.7), sweep_boxes=box(0.9))
    blank = lambda t, **k: row(t, picture(), **{**seen, "det_boxes": box(0.4), **k})
    spot = lambda t, **k: row(t, picture(100, [5]), **{**seen, **k})
    dwell = VERIFYING.dwell
    out = play([blank(0)] + [spot(30.0 * (i + 1)) for i in range(dwell + 1)], VERIFYING)
    assert all(r["verify_boxes"] == [] for r in out[:dwell])  # nothing hot, the detector is not asked
    assert out[dwell]["verify_boxes"] == box(0.4) and out[dwell]["verify_conf"] == 0.4 and out[dwell]["n_hot"] == 0
    assert out[dwell + 1]["verify_boxes"] == box(0.4) + box(0.7) and out[dwell + 1]["n_escalated_hot"] == 1
    swept = play([blank(0), row(30, picture(), control="reset", **{**seen, "sweep_hit": hit})]
                 + [row(60 + 30 * i, picture(), **{**seen, "sweep_hit": hit}) for i in range(dwell)], VERIFYING)
    added = [r for r in swept if r["n_sweep_hot"]]
    assert added and all(r["verify_boxes"] == box(0.9) for r in added)
    lost = lambda r: {**r, "det_hit": None, "det_boxes": None}
    failed = play([blank(0)] + [lost(spot(30.0 * (i + 1))) for i in range(dwell)], VERIFYING)
    assert failed[-1]["verify_failed"] and failed[-1]["verify_boxes"] == [] and failed[-1]["n_hot"] == 1


def test_a_scorer_is_made_once_per_task_and_checked(spark):
    frames = spark.createDataFrame([("c", i, bytes([i * 10] * 64)) for i in range(4)], "camera_id string, scan_no long, data binary").selectExpr(
        "*", "timestamp_seconds(scan_no * 30) AS ts", "8 AS width", "8 AS height", "1 AS channels").coalesce(1)
    cells = spark.createDataFrame([("c", "z", "g", 0, k, 4 * k, 0, 4 * k + 4, 8) for k in range(2)],
                                  "camera_id string, zone_id string, sig string, row int, col int, x1 int, y1 int, x2 int, y2 int")

    def make():
        made = []

        def score(patches):
            made.append(1)
            return [float(p.mean()) + len(made) / 1000 for p in patches]
        return score
    got = sorted((r["scan_no"], r["score"]) for r in PX.describe_frames(frames, cells, make).collect())
    assert [len(s) for _, s in got] == [2] * 4 and [int(s[0]) for _, s in got] == [0, 10, 20, 30]
    assert sorted(round(s[0] % 1, 3) for _, s in got) == [0.001, 0.002, 0.003, 0.004]
    with pytest.raises(Exception, match="1 scores for 2 patches"):
        PX.describe_frames(frames, cells, lambda: lambda patches: [0.5]).collect()


def test_table_functions_are_the_operators(spark):
    rng = random.Random(2)
    zones = spark.createDataFrame([(f"c{i}", "z", [[rng.random(), rng.random()] for _ in range(rng.choice([3, 4, 11]))], 640, 480) for i in range(30)],
                                  "camera_id string, zone_id string, points array<array<double>>, frame_w int, frame_h int")
    register_tables(spark)
    zones.createOrReplaceTempView("some_zones")
    for cell, overlap in ((64, 0.5), (50, 0.37), (3, 0.95)):
        want = GR.build_grid(zones, cell, overlap)
        got = spark.sql(f"SELECT * FROM build_grid(TABLE(some_zones), {cell}, {overlap}D)")
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="lacks frame_w"):
        spark.sql("SELECT * FROM build_grid(TABLE(SELECT points FROM some_zones), 64, 0.5)").collect()
    with pytest.raises(Exception, match="3 points"):
        spark.sql("SELECT * FROM build_grid(TABLE(SELECT slice(points, 1, 2) AS points, frame_w, frame_h FROM some_zones), 64, 0.5)").collect()


def test_sketches_merge_within_their_rank_error(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.gamma(2.0, 1.0, 60_000), np.full(5_000, 3.25), rng.normal(40, 1, 300)])
    rng.shuffle(values)
    df = spark.createDataFrame([(int(i % 7), int(i % 450), float(v)) for i, v in enumerate(values)], "day int, scan_no int, v double").withColumn("site", F.lit("a"))
    stored = calibrate.value_sketches(df, ["site", "day"], "v", "scan_no")
    named = {f"p{k}": p for k, p in enumerate((0.0, 0.05, 0.5, 0.9, 0.99, 0.999, 1.0))}
    got = calibrate.merged_quantiles(stored, ["site"], named).first()
    assert got["n"] == len(values) and abs(got["n_scans"] - 450) < 25
    for name, p in named.items():
        low, high = (values < got[name]).mean(), (values <= got[name]).mean()
        assert low - 0.0015 <= p <= high + 0.0015
    few = calibrate.noise_floor_sketch(*[calibrate.value_sketches(df.filter("scan_no < 9"), ["site", "day"], "v", "scan_no")] * 3, ["site"]).first()
    assert few["thr"] is None and few["n_scores"] > 0


def test_pixels_of_scenes_are_neither_written_nor_shuffled(spark, monkeypatch):
    from zonewatch.catalog import pictures as C
    rows, original = [], PX.materialize if hasattr(PX, "materialize") else C.materialize

    def counted(df):
        kept = original(df)
        rows.append(kept.count())
        return kept
    monkeypatch.setattr(PX, "materialize", counted, raising=False)
    monkeypatch.setattr(C, "materialize", counted, raising=False)
    monkeypatch.setattr(C.B, "table", lambda spark, sf, name: spark.range(1, 5).withColumnRenamed("id", "s_suppkey"))
    keys = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(keys, "true")
    assert C.left_object_events(spark, "").count() == 4 and spark.conf.get(keys) == before
    assert max(rows) < 4 * C.FRAMES * C.SCENE ** 2 / 4


def test_background_is_the_cut_median(spark):
    rng = np.random.default_rng(4)
    gray = rng.integers(0, 256, (7, 5, 3))
    rows = [("a", f, r, c, None if (f, r, c) == (1, 2, 2) else int(gray[f, r, c])) for f in range(7) for r in range(5) for c in range(3)]
    df = spark.createDataFrame(rows, "k string, frame int, row int, col int, gray int")
    for warm in (1, 4, 5):
        got = {(r.row, r.col): r.ref for r in PX.median_background(df, ["k"], "frame", warm).collect()}
        want = {}
        for r in range(5):
            for c in range(3):
                seen = [gray[f, r, c] for f in range(warm) if (f, r, c) != (1, 2, 2)]
                want[r, c] = int(np.floor(np.median(seen)))
        assert got == want
