import random
import re

import numpy as np
import pytest

from zonewatch.operators import boxes as BX
from zonewatch.operators import clusters as C
from zonewatch.operators import pixels as P
from zonewatch.operators import sampling as S
from zonewatch.operators import tiling as TL


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(w, 0) * max(h, 0)
    return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i + 1e-9)


@pytest.fixture(scope="module")
def crowd():
    rng = random.Random(2)
    out = []
    for img, n in ((1, 60), (2, 7)):
        for _ in range(n):
            x, y = rng.randint(0, 700), rng.randint(0, 300)
            out.append((img, float(x), float(y), float(x + rng.randint(20, 300)), float(y + rng.randint(20, 300)),
                        rng.randint(1, 20) / 20))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "image int, x1 double, y1 double, x2 double, y2 double, score double")


def test_nms_equals_greedy_with_chains_and_ties(spark, crowd):
    chain = [(3, 40.0 * i, 0.0, 40.0 * i + 100, 50.0, 1 - i / 50) for i in range(12)]
    rows = crowd + chain + [crowd[0]]
    want = set()
    for img in (1, 2, 3):
        todo = sorted({r for r in rows if r[0] == img}, key=lambda r: (-r[5], *r[1:5]))
        kept = []
        for r in todo:
            if all(iou(r[1:5], k[1:5]) <= 0.4 for k in kept):
                kept.append(r)
        want |= set(kept)
    assert {tuple(r) for r in BX.nms(frame(spark, rows), ["image"], 0.4).collect()} == want


def test_spatial_pairs_equal_all_pairs(spark, crowd):
    ids = ["x1", "y1", "x2", "y2"]
    got = {(r.image, r.a_x1, r.a_y1, r.b_x1, r.b_y1) for r in
           BX.iou_pairs(frame(spark, crowd), ["image"], ids, 0.2).collect()}
    want = {(a[0], a[1], a[2], b[1], b[2]) for a in crowd for b in crowd
            if a[0] == b[0] and a[1:5] < b[1:5] and iou(a[1:5], b[1:5]) > 0.2}
    assert got == want and want


def cells(spark):
    rng = random.Random(4)
    rows = [("s", rng.randint(0, 25), rng.randint(0, 25)) for _ in range(230)] + [("t", 0, 0), ("t", 1, 1), ("t", 5, 5)]
    return spark.createDataFrame(rows, "scan string, row int, col int")


def test_components_by_task_and_by_rounds_agree(spark):
    c = cells(spark)
    key = lambda df: sorted(tuple(r[k] for k in ("scan", "row", "col", "comp_row", "comp_col")) for r in df.collect())
    fast = key(C.components(c, ["scan"]))
    assert fast == key(C.components_by_blocks(c.distinct(), ["scan"], 1, side=7))
    assert [r for r in fast if r[0] == "t"] == [("t", 0, 0, 0, 0), ("t", 1, 1, 0, 0), ("t", 5, 5, 5, 5)]


def test_thinning_reports_what_it_left_out(spark):
    df = spark.range(100).selectExpr("1 g", "id")
    out = C.thin(df, 12, ["g"], ["id"]).collect()
    assert [r.id for r in sorted(out, key=lambda r: r.id)] == list(range(0, 100, 9)) and {r.n for r in out} == {100}


def test_tile_labels_against_brute_force(spark):
    images = spark.createDataFrame([(1, 700, 500), (2, 330, 320)], "image int, width int, height int")
    rng = random.Random(9)
    rows = []
    for img, w, h in ((1, 700, 500), (2, 330, 320)):
        for _ in range(6):
            x, y = rng.randint(0, w - 60), rng.randint(0, h - 60)
            rows.append((img, float(x), float(y), float(x + rng.randint(10, 60)), float(y + rng.randint(10, 60))))
    boxes = spark.createDataFrame(rows, "image int, x1 double, y1 double, x2 double, y2 double").join(images, "image")
    tiles, labels = TL.label_tiles(images, boxes, ["image"], 320, 0.5)
    got = {(r.image, r.tile_no): r.n_labels for r in tiles.collect()}
    want, n = {}, 0
    for img, w, h in ((1, 700, 500), (2, 330, 320)):
        def starts(size):
            s = list(range(0, max(1, size - 320 + 1), 160))
            return s + [size - 320] if s[-1] + 320 < size else s
        for no, (ty, tx) in enumerate((ty, tx) for ty in starts(h) for tx in starts(w)):
            fr = []
            for _, x1, y1, x2, y2 in (r for r in rows if r[0] == img):
                i = max(0, min(x2, tx + 320) - max(x1, tx)) * max(0, min(y2, ty + 320) - max(y1, ty))
                fr.append(i / ((x2 - x1) * (y2 - y1)))
            if not any(0.1 < f < 0.6 for f in fr):
                want[img, no] = sum(f >= 0.6 for f in fr)
                n += want[img, no]
    assert got == want and labels.count() == n


def test_sampling_is_repeatable(spark):
    df = spark.range(200).selectExpr("id % 3 AS src", "id")
    a, b = (sorted(tuple(r) for r in S.cap_per_group(df, 5, ["src"], ["id"]).collect()) for _ in range(2))
    assert a == b and len(a) == 15
    assert S.quota_sample(df, 8, ["src"], ["id"]).count() == 6


def test_area_mean_and_shift():
    g = np.arange(64 * 64).reshape(64, 64) % 251
    assert np.allclose(P.area_weights(64, 8).sum(axis=1), 1)
    assert np.allclose(P.shrink(g, 8, 8), np.rint(g.reshape(8, 8, 8, 8).mean(axis=(1, 3))))
    noise = np.random.default_rng(0).normal(size=(64, 64))
    dx, dy = P.phase_shift(noise, np.roll(noise, (3, -5), (0, 1)))
    assert abs(abs(dx) - 5) < 0.3 and abs(abs(dy) - 3) < 0.3


def test_left_object_is_found(spark):
    """Ten empty pictures, then a block that stays; a passing block does not count."""
    rows = []
    for i in range(30):
        for y in range(24):
            for x in range(32):
                v = 100
                if i >= 12 and 8 <= y < 14 and 8 <= x < 16:
                    v = 200
                if i == 20 and y < 6 and x > 20:
                    v = 220
                rows.append(("v", i, y, x, v))
    px = spark.createDataFrame(rows, "cam string, frame int, row int, col int, gray int")
    r = P.find_events(px, ["cam"], "frame", 32, 24, warm=10, min_area=20, max_frac=0.5).first()
    assert r.event_frame == 12 and (r.x1, r.y1, r.x2, r.y2) == (5, 5, 19, 17)
    bg = P.median_background(px, ["cam"], "frame", 10)
    objs = P.diff_objects(px.filter("frame = 25"), bg, ["cam", "frame"], ["cam"], 32, 24, left=0.0, shrink=1).collect()
    assert [(o.x1, o.y1, o.x2, o.y2) for o in objs] == [(3, 3, 21, 19)]


def test_crops_keep_their_rules(spark, crowd):
    df = frame(spark, crowd).selectExpr("image", "x1", "y1", "x2", "y2", "1000 AS width", "600 AS height")
    ids = ["x1", "y1", "x2", "y2"]
    crops, labels = TL.repeat_crops(df, ["image"], ids, 4, 320)
    rows = crops.collect()
    assert len(rows) == 8 and rows == TL.repeat_crops(df, ["image"], ids, 4, 320)[0].collect()
    assert all(0 <= r.cx1 and r.cx2 <= 1000 and r.cx2 - r.cx1 == 320 and 0 <= r.cy1 and r.cy2 <= 600 for r in rows)
    assert all(0 <= r.lx1 and r.lx2 <= 320 and r.lx2 - r.lx1 >= 4 for r in labels.collect())

    crops, labels = TL.target_crops(df, ["image"], ids, 0.2, 0.35, copies=3)
    at = {(r.image, r.copy): r for r in crops.collect()}
    assert len(at) == 6 and all(24 <= r.cx2 - r.cx1 <= 600 + 1e-9 and 0 <= r.cx1 <= r.cx2 <= 1000 + 1e-9 for r in at.values())
    for r in labels.collect():
        assert -1e-6 <= r.lx1 < r.lx2 <= 640 + 1e-6 and r.lx2 - r.lx1 >= 4
    assert {(r.image, r.copy) for r in labels.collect()} == set(at)  # the chosen object is always seen


@pytest.mark.parametrize("gap,side,linked", [(1, 4, 10 ** 6), (2, 5, 10 ** 6), (1, 3, 0), (3, 1, 10 ** 6)])
def test_components_in_blocks(spark, monkeypatch, gap, side, linked):
    """Blocks of any size give the labels of one pass over the whole scan, also where the linked labels of
    a scan are settled in rounds (`linked` 0)."""
    rng = random.Random(gap)
    cells = [(s, r, c) for s in range(3) for r in range(-9, 22) for c in range(-14, 25) if rng.random() < (0.08, 0.2, 0.42)[s] / gap]
    cells += [(3, r, 0 if r % 4 else c) for r in range(40) for c in range(9)]  # one winding shape
    cells += [(3, r, c) for k, r in enumerate(range(1, 40, 4)) for c in ([8] if k % 2 else [0])]
    df = spark.createDataFrame(sorted(set(cells)), "scan int, row int, col int")
    want = C._labelled(df, ["scan"], gap)
    if not linked:
        monkeypatch.setattr(C, "COMPONENT_CELLS", 0)
    got = C.components_by_blocks(df, ["scan"], gap, side)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert C.components_by_blocks(df.limit(0), ["scan"], gap, side).count() == 0


def test_tile_labels_are_dealt_out_by_image_alone(spark):
    """Parts of bounded size by image, and no further shuffle of the boxes and their tiles."""
    import os

    import pytest
    from zonewatch.catalog import QUERIES
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    plan = QUERIES["tile_labels"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and not any("tile_no" in line or "x1" in line for line in shuffles)


def test_boxes_list_the_tiles_they_meet(spark):
    rng = random.Random(4)
    sizes = [(w, h) for w in (100, 320, 321, 480, 500, 1000) for h in (200, 320, 640, 799)]
    rows = []
    for i in range(600):
        (w, h), x, y = sizes[i % len(sizes)], rng.randint(-60, 1100), rng.randint(-60, 820)
        rows.append((i, w, h, float(x), float(y), float(x + rng.choice([1, 40, 160, 400, 2000])), float(y + rng.choice([1, 160, 321]))))
    df = spark.createDataFrame(rows, "image long, width int, height int, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r.image, r.tile_no, r.r_x1, r.r_y1, r.r_x2, r.r_y2) for r in TL.box_in_tile(df, 320, 0.5).collect())

    def starts(n):
        return [0] if n <= 320 else sorted({*range(0, n - 319, 160), n - 320})
    want = [(i, ny * len(starts(w)) + nx, tx, ty, min(w, tx + 320), min(h, ty + 320)) for i, w, h, x1, y1, x2, y2 in rows
            for nx, tx in enumerate(starts(w)) for ny, ty in enumerate(starts(h))
            if x1 < min(w, tx + 320) and x2 > tx and y1 < min(h, ty + 320) and y2 > ty]
    assert got == sorted(want) and len(got) > 500


def exchanges(spark, name):
    from zonewatch.catalog import QUERIES
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^()]*?), \d+\)", plan)]


@pytest.mark.parametrize("name,last", [("tile_kinds", {"n_labels"}), ("negatives_per_image", set()), ("repeat_crops", set()), ("target_crops", set())])
def test_images_are_dealt_out_once(spark, name, last):
    """Neither tiles nor crops are shuffled: images and boxes go to the task of their image, and only totals go on."""
    assert set(exchanges(spark, name)) == {"image"} | last


def test_only_tiles_with_labels_meet_them(spark):
    from zonewatch.catalog import QUERIES
    plan = QUERIES["tile_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n_labels,0)" in plan


def test_models_are_told_apart_at_their_image(spark):
    gt = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 250.0, 250.0, 300.0, 300.0), (2, 0.0, 0.0, 10.0, 10.0)], "image long, x1 double, y1 double, x2 double, y2 double")
    det = spark.createDataFrame([(1, 4.0, 4.0, 6.0, 6.0, "a"), (1, 3.0, 3.0, 6.0, 6.0, "a"), (1, 270.0, 270.0, 280.0, 280.0, "b"), (1, 4.0, 4.0, 6.0, 6.0, "b"), (3, 4.0, 4.0, 6.0, 6.0, "b")],
                                "image long, x1 double, y1 double, x2 double, y2 double, model string")
    got = sorted(map(tuple, BX.matched_by(gt, det, ["image"], ["x1", "y1"], ["model"]).collect()))
    assert got == [(1, "a", 0.0, 0.0), (1, "b", 0.0, 0.0), (1, "b", 250.0, 250.0)]


def test_many_small_scans_are_labelled_together(spark):
    rng = random.Random(6)
    rows = [(f"s{i % 40}" if i % 40 else None, rng.randint(-5, 6), rng.randint(-5, 6) + 10_000 * (i % 3)) for i in range(1200)]
    df = spark.createDataFrame(rows, "scan string, row int, col int").distinct()
    for gap in (1, 2):
        got = {(r.scan, r.row, r.col): (r.comp_row, r.comp_col) for r in C.components(df, ["scan"], gap).collect()}
        cells = {(r.scan, r.row, r.col) for r in df.collect()}
        want = {}
        for cell in sorted(cells, key=str):
            if cell not in want:
                found, stack = {cell}, [cell]
                while stack:
                    s, r, c = stack.pop()
                    near = {(s, r + i, c + j) for i in range(-gap, gap + 1) for j in range(-gap, gap + 1)} & cells - found
                    found |= near
                    stack += near
                want |= dict.fromkeys(found, min((r, c) for _, r, c in found))
        assert got == want
    plan = C.components(df, ["scan"], 1)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas [_deal" in plan  # not a call for each scan
