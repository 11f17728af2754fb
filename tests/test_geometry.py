import hashlib
import random

import pytest
from pyspark.sql import functions as F

from zonewatch.functions import geometry as G
from zonewatch.functions import grading, keys
from zonewatch.functions.replies import parse_replies
from zonewatch.operators import grid as GR

RECT = [[200 / 1920, 300 / 1080], [1000 / 1920, 300 / 1080], [1000 / 1920, 700 / 1080], [200 / 1920, 700 / 1080]]


def zones(spark, points, w, h):
    return spark.createDataFrame([("c", "z", points, w, h)],
                                 "camera_id string, zone_id string, points array<array<double>>, frame_w int, frame_h int")


def test_grid_of_a_rectangle(spark):
    cells = GR.build_grid(zones(spark, RECT, 1920, 1080), 64, 0.5).collect()
    assert len(cells) == 24 * 12
    assert max(c.col for c in cells) == 23 and max(c.row for c in cells) == 11
    assert max(c.x2 for c in cells) == 1000 and max(c.y2 for c in cells) == 700


def test_grid_signature_matches_sha1_and_follows_every_input(spark):
    poly = "200,300|1000,300|1000,700|200,700"
    want = hashlib.sha1(f"1920x1080|c64|o0.50|{poly}".encode()).hexdigest()[:16]
    sig = lambda *a: GR.zone_layout(zones(spark, *a[:3]), *a[3:]).first().sig
    assert sig(RECT, 1920, 1080, 64, 0.5) == want
    assert len({want, sig(RECT, 1920, 1080, 48, 0.5), sig(RECT, 1920, 1080, 64, 0.4), sig(RECT, 1280, 720, 64, 0.5),
                sig([*RECT[:3], [0.11, 0.64]], 1920, 1080, 64, 0.5)}) == 5


def test_small_zone_and_too_few_points(spark):
    corner = [[0.0, 0.0], [70 / 640, 0.0], [70 / 640, 60 / 480], [0.0, 60 / 480]]
    assert [(c.row, c.col, c.x1) for c in GR.build_grid(zones(spark, corner, 640, 480), 64, 0.5).collect()] == [
        (0, 0, 0), (0, 1, 6)]
    with pytest.raises(Exception, match="3 points"):
        GR.build_grid(zones(spark, RECT[:2], 640, 480), 64, 0.5).collect()


def even_odd(x, y, poly):
    inside = False
    for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


@pytest.mark.parametrize("n", [3, 8, 15])
def test_points_in_polygons_of_any_size(spark, n):
    rng = random.Random(n)
    poly = [[rng.randint(0, 100), rng.randint(0, 100)] for _ in range(n)]
    pts = [(rng.random() * 110 - 5, rng.random() * 110 - 5) for _ in range(300)]
    df = spark.createDataFrame([(x, y, poly) for x, y in pts], "x double, y double, poly array<array<int>>")
    got = [r[0] for r in df.select(G.point_in_polygon(F.col("x"), F.col("y"), F.col("poly"))).collect()]
    assert got == [even_odd(x, y, poly) for x, y in pts]


def test_concave_and_degenerate(spark):
    ell = [[0, 0], [100, 0], [100, 50], [50, 50], [50, 100], [0, 100]]
    df = spark.createDataFrame([(25.0, 75.0, ell), (75.0, 75.0, ell), (75.0, 25.0, ell), (1.0, 1.0, ell[:2])],
                               "x double, y double, p array<array<int>>")
    assert [r[0] for r in df.select(G.point_in_polygon(F.col("x"), F.col("y"), F.col("p"))).collect()] == [
        True, False, True, False]


def test_overlap_cases(spark):
    cell = "0D x1, 0D y1, 64D x2, 64D y2"
    cases = [((0, 0, 64, 64), 1.0), ((100, 100, 200, 200), 0.0), ((0, 0, 32, 32), 0.25)]
    for b, want in cases:
        df = spark.sql(f"select {cell}, {b[0]}D b_x1, {b[1]}D b_y1, {b[2]}D b_x2, {b[3]}D b_y2")
        assert df.select(G.overlap_frac(G.box(), G.box("b_"))).first()[0] == want


def test_occlusion_is_existence_and_pad_widens(spark):
    cells = GR.build_grid(zones(spark, RECT, 1920, 1080), 64, 0.5)
    person = spark.createDataFrame([("c", 300.0, 400.0, 360.0, 560.0)],
                                   "camera_id string, x1 double, y1 double, x2 double, y2 double")
    n = lambda pad: GR.occluded_cells(cells, person, ["camera_id"], 0.3, pad).count()
    assert 0 < n(0) < n(48)
    assert GR.drop_occluded(cells, person, ["camera_id"], 0.3, 48).count() == 288 - n(48)


def test_split_is_stable_and_by_clip(spark):
    df = spark.createDataFrame([("RoLID1", "a/x_frame1822.jpg"), ("RoLID1", "b/x_frame1823.jpg"),
                                ("UAVVaste", "BATCH_s1_img_2.jpg"), ("TACO", "batch_1/000001.jpg"),
                                ("TACO", "batch_2/000001.jpg")], "s string, f string")
    out = df.select(keys.clip_key(F.col("s"), F.col("f")).alias("k")).withColumn("sp", keys.split_of(F.col("k"))).collect()
    assert [r.k for r in out] == ["R:x", "R:x", "U:BATCH_s1", "batch_1/000001.jpg", "batch_2/000001.jpg"]
    for r in out:
        want = "val" if int(hashlib.md5(r.k.encode()).hexdigest()[:8], 16) % 10000 < 1500 else "train"
        assert r.sp == want


def test_replies(spark):
    cases = [('```json\n{"litter": true, "confidence": 0.8, "what": "bag"}\n```', 0.8, "bag"),
             ('{"litter": false, "confidence": 0.9}', 0.1, ""), ('{"litter": true, "confidence": 7}', 1.0, ""),
             ('{"litter": true}', 1.0, ""), ('{"litter": false}', 1.0, ""), ('{"litter": "false"}', 1.0, ""),
             ('{"litter": 0, "confidence": "0.25"}', 0.75, ""), ("Yes, a bag", 1.0, "unparsed-yes"),
             ("**Yes**", 1.0, "unparsed-yes"), ("có rác", 1.0, "unparsed-yes"), ("I see a road", 0.0, "unparsed: I see a road"),
             ('{"litter": true, broken', 1.0, "unparsed-yes"), ("{nothing}", 0.0, "unparsed: {nothing}"),
             ('{"litter": true, "confidence": null}', 1.0, "unparsed-yes")]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t string").coalesce(1)
    for r in parse_replies(df, "t", "s", "n").collect():
        assert (round(r.s, 9), r.n) == (cases[r.i][1], cases[r.i][2]), cases[r.i]


def test_bands_and_rates(spark):
    df = spark.createDataFrame([(0.0,), (11.9,), (12.0,), (79.0,), (80.0,), (1e9,)], "v double").coalesce(1)
    assert [r[0] for r in df.select(grading.band(F.col("v"), grading.PX_BANDS)).collect()] == [
        "0-12", "0-12", "12-20", "48-80", "80+", "80+"]
    r = spark.createDataFrame([(5, 1.9), (5, 48.0), (1, 48.0)], "n int, h double").coalesce(1)
    rate = grading.rate_per_day(F.col("n"), F.col("h"))
    assert [tuple(x) for x in r.select(rate, grading.rate_verdict(rate)).collect()] == [
        (None, "too short"), (2.5, "fail"), (0.5, "pass")]
