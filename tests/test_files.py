import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewatch import schemas
from zonewatch.operators import detect as DT
from zonewatch.operators import pixels as P
from zonewatch.plans import dataset as D
from zonewatch.plans import runlog
from zonewatch.sinks import writers as W
from zonewatch.sources import readers as RD


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_zone_and_truth_files(spark, tmp_path):
    put(tmp_path / "z/cam1.json", json.dumps({"points": [[0, 0], [1, 0], [1, 1]]}))
    z = RD.read_zones(spark, str(tmp_path / "z")).first()
    assert (z.camera_id, len(z.points)) == ("cam1", 3)
    put(tmp_path / "bad/cam2.json", json.dumps({"points": [[0, 0], [1, 0]]}))
    with pytest.raises(Exception, match="3 points"):
        RD.read_zones(spark, str(tmp_path / "bad")).collect()
    put(tmp_path / "t/cam1.json", json.dumps({"intervals": [[120, 900], [3600, 5400]]}))
    assert [(r.camera_id, r.event_id, r.a, r.b) for r in RD.read_truth(spark, str(tmp_path / "t")).collect()] == [
        ("cam1", 0, 120.0, 900.0), ("cam1", 1, 3600.0, 5400.0)]


def test_coco_documents(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 100, "height": 80, "flickr_url": "u"}],
           "annotations": [{"id": 1, "image_id": 1, "category_id": 7, "bbox": [10, 10, 20, 200]},
                           {"id": 2, "image_id": 1, "category_id": 9, "bbox": [0, 0, 1, 1]}],
           "categories": [{"id": 7, "name": "Plastic bag", "supercategory": "Bag & wrapper"}]}
    i, a, c = RD.read_coco(spark, put(tmp_path / "c.json", json.dumps(doc)), "S")
    j = D.xywh_boxes(D.join_annotations(a, i, c))
    assert sorted((r.name, r.x2, r.y2) for r in j.collect()) == [("?", 1.0, 1.0), ("Plastic bag", 30.0, 210.0)]
    assert D.filter_classes(j, words=["bag", "wrapper"]).count() == 1
    k = D.rescale_boxes(j.withColumns({"disk_width": F.lit(50.0), "disk_height": F.lit(40.0)})).collect()
    assert [(r.x1, r.y1, r.x2, r.y2, r.rescaled) for r in k] == [(5.0, 5.0, 15.0, 40.0, True)]
    assert i.first().url == "u"


def test_yolo_and_region_files(spark, tmp_path):
    put(tmp_path / "l/a.txt", "0 0.5 0.5 0.1 0.1\n1 0.5 0.5\n2 0.1 0.1 0.2 0.2\n")
    put(tmp_path / "l/b.txt", "\n")
    assert RD.read_yolo(spark, str(tmp_path / "l"), "s").count() == 2
    assert [r.cls for r in RD.read_yolo(spark, str(tmp_path / "l"), "s", keep=[2]).collect()] == [2]
    for d in ("q1", "q2"):
        put(tmp_path / f"img/{d}/x.jpg", "x")
    csv = put(tmp_path / "r.csv", "filename,x1,y1,x2,y2\nx.jpg,1,2,3,4\nx.jpg,a,2,3,4\nnone.jpg,1,1,2,2\n")
    out = RD.read_region_csv(spark, csv, RD.read_listing(spark, str(tmp_path / "img"), "*.jpg")).collect()
    assert len(out) == 1 and out[0].path.endswith("q1/x.jpg")


def test_scan_logs_keep_quoted_commas_and_order(spark, tmp_path):
    head = ",".join(schemas.SCAN_LOG.names)
    line = lambda t, cells: f'{t},1,1,0,2,2,9,0,3,9,0,0,0.5,0,0,1,1,1.0,0,0,0,0,3,0,0.0,12.5,"{cells}",'
    put(tmp_path / "scans.csv", "\n".join([head, line(0, "1,2 3,4"), line(30, "")]) + "\n")
    put(tmp_path / "scans_20240101-100000.csv", "\n".join([head, line(0, ""), line(60, "")]) + "\n")
    log = RD.read_scan_log(spark, str(tmp_path / "*.csv"))
    assert sorted(len(r.cells) for r in log.filter("hot_cells is not null").collect())[-1] == 2
    st = runlog.stitch_segments(log.withColumn("cam", F.lit("c")), ["cam"], ["segment_order", "t_s"])
    assert [r.t_run for r in st.orderBy("t_run").collect()] == [0.0, 60.0, 90.0, 120.0]


def test_frames_to_descriptors(spark):
    g = np.zeros((64, 64, 3), np.uint8)
    g[:, 32:] = 200
    f = spark.createDataFrame([("c", 0, None, 64, 64, 3, bytearray(g.tobytes()))],
                              "camera_id string, scan_no bigint, ts timestamp, width int, height int, channels int, data binary")
    f = f.withColumn("ts", F.timestamp_seconds(F.lit(30)))
    cells = spark.createDataFrame([("c", "z", "g", 0, 0, 0, 0, 32, 32), ("c", "z", "g", 0, 1, 16, 0, 48, 32)],
                                  "camera_id string, zone_id string, sig string, row int, col int, x1 int, y1 int, x2 int, y2 int")
    r = P.describe_frames(f, cells).first()
    assert (r.n_cells, r.t_s, list(r.cols)) == (2, 30.0, [0, 1])
    assert set(r.desc[:64]) == {0.0} and set(r.desc[64:]) == {-100.0, 100.0}


def test_detectors_and_alert_rows(spark, tmp_path):
    det = spark.createDataFrame([("c", 100.0, 100.0, 140.0, 140.0, 0.9, "bag"), ("c", 500.0, 400.0, 520.0, 420.0, 0.9, "bag")],
                                "camera_id string, x1 double, y1 double, x2 double, y2 double, score double, label string")
    hot = spark.createDataFrame([("c", 3, 3, 96, 96, 160, 160, 640, 480), ("c", 9, 0, 0, 288, 64, 352, 640, 480)],
                                "camera_id string, row int, col int, x1 int, y1 int, x2 int, y2 int, frame_w int, frame_h int")
    kept, boxes, left_out = DT.verify(hot, DT.TableDetector(det), ["camera_id"])
    assert [(r.row, r.col) for r in kept.collect()] == [(3, 3)] and boxes.count() == 1 and left_out.count() == 0
    assert [tuple(r) for r in DT.verify(hot, DT.TableDetector(det), ["camera_id"], max_regions=1).left_out.collect()] == [("c", "regions", 2, 1)]
    swept = DT.sweep_verify(hot, DT.TableDetector(det), ["camera_id"], max_tiles=3).left_out.first()
    assert swept.what == "tiles" and swept.n > swept.n_kept == 3

    def make():
        def model(pdf):
            return pdf[["camera_id", "tx1", "ty1", "scale"]].assign(bx1=0.0, by1=0.0, bx2=20.0, by2=20.0, score=0.5, label="x")
        return model
    got = DT.CallableDetector(make).detect(hot.selectExpr("camera_id", "x1 tx1", "y1 ty1", "x2 tx2", "y2 ty2", "2.0D scale"), ["camera_id"])
    assert sorted((r.x1, r.x2) for r in got.collect()) == [(0.0, 10.0), (96.0, 106.0)]
    assert DT.build_scorer("constant", value=0.3)(hot).first().score == 0.3
    with pytest.raises(ValueError):
        DT.build_scorer("other")

    scans = spark.createDataFrame([("c", 1, True, 2, 1, False, 0), ("c", 2, True, 1, 1, True, 1), ("c", 3, False, 0, 0, False, 0)],
                                  "camera_id string, scan_no int, alert boolean, n_hot int, n_fresh int, escalated boolean, n_sweep_hot int")
    conf = spark.createDataFrame([("c", 1, 1.0, 2.0, 3.0, 4.0, 0.87654)], "camera_id string, scan_no int, x1 double, y1 double, x2 double, y2 double, conf double")
    hull = spark.createDataFrame([("c", 1, 0, 0, 9, 9), ("c", 2, 5, 5, 9, 9)], "camera_id string, scan_no int, x1 int, y1 int, x2 int, y2 int")
    rows = {r.scan_no: r for r in W.alert_rows(scans, conf, hull, ["camera_id", "scan_no"]).collect()}
    assert rows[1].bbox == [1.0, 2.0, 3.0, 4.0] and rows[1].extra.det_conf == 0.877 and rows[1].score == 1.0
    assert rows[2].bbox == [5.0, 5.0, 9.0, 9.0] and rows[2].extra.det_conf is None and rows[2].extra.from_sweep


def test_dataset_and_report_sinks(spark, tmp_path):
    tiles = spark.createDataFrame([("train", "S", "S_1_t0", 0), ("val", "S", "S_2_t1", 1)], "split string, source string, stem string, tile_no int")
    labels = spark.createDataFrame([("train", "S", "S_1_t0", 0, 0.0, 0.0, 320.0, 640.0)],
                                   "split string, source string, stem string, cls int, x1 double, y1 double, x2 double, y2 double")
    W.write_tiles(tiles, labels, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d/tiles")).count() == 2
    W.write_yolo_text(labels, str(tmp_path / "y"), F.lit(640.0))
    assert spark.read.text(str(tmp_path / "y")).first().value == "S_1_t0\t0 0.250000 0.500000 0.500000 1.000000"
    back = RD.read_yolo_lines(spark, str(tmp_path / "y"), "S").first()
    assert (back.split, back.stem, back.cls, back.cx, back.h, back.source) == ("train", "S_1_t0", 0, 0.25, 1.0, "S")
    W.write_report(tiles.select("stem"), str(tmp_path / "m"), "markdown")
    assert {r.value for r in spark.read.text(str(tmp_path / "m")).collect()} == {"| S_1_t0 |", "| S_2_t1 |"}
    z = spark.createDataFrame([("c", "z", [[0.123456, 1.0]])], "camera_id string, zone_id string, points array<array<double>>")
    W.write_zones(z, str(tmp_path / "z"))
    assert spark.read.json(str(tmp_path / "z")).first().points == [[0.1235, 1.0]]


def bmp(gray):
    """A 24-bit bitmap; side lengths are multiples of four, so rows need no padding."""
    import struct
    h, w = gray.shape
    body = np.repeat(gray[::-1, :, None], 3, axis=2).astype(np.uint8).tobytes()
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def test_image_folder_as_frames(spark, tmp_path):
    pic = np.tile(np.arange(0, 64, dtype=np.uint8), (64, 1))
    for name, p in (("b.bmp", pic), ("a.bmp", pic + 50)):
        (tmp_path / name).write_bytes(bmp(p))
    (tmp_path / "ab.jpg").write_bytes(b"not an image")  # counts for the time of what follows
    (tmp_path / "notes.txt").write_text("no")
    frames = RD.read_frames(spark, str(tmp_path), "cam", 30)
    rows = frames.orderBy("scan_no").collect()
    assert [(r.scan_no, r.ts.timestamp(), r.width, r.channels) for r in rows] == [(0, 0.0, 64, 3), (2, 60.0, 64, 3)]
    every = RD.read_frames(spark, str(tmp_path), "cam", 30, keep_unreadable=True).orderBy("scan_no").collect()
    assert [(r.scan_no, r.width) for r in every] == [(0, 64), (1, None), (2, 64)]
    (tmp_path / "c.webp").write_bytes(b"RIFF")
    with pytest.raises(Exception, match="pass decode"):
        RD.read_frames(spark, str(tmp_path), "cam", 30).count()
    mine = RD.read_frames(spark, str(tmp_path), "cam", 30, decode=lambda b: (2, 1, 3, b[:6]) if b[:2] in (b"BM", b"RI") else None)
    assert [(r.scan_no, r.width, bytes(r.data)[:2]) for r in mine.orderBy("scan_no").collect()] == [(0, 2, b"BM"), (2, 2, b"BM"), (3, 2, b"RI")]
    (tmp_path / "c.webp").unlink()
    thumbs = P.thumbs(frames, 16)
    first = np.frombuffer(thumbs.orderBy("scan_no").first().thumb, np.float32).reshape(16, 16)
    assert first[0, 0] == np.rint((pic[:4, :4] + 50).mean()) and first.shape == (16, 16)
    assert {r.shift_px for r in P.scene_shift(thumbs, ["camera_id"], "scan_no").collect()} >= {0.0}
