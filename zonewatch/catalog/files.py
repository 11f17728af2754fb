"""Queries over sources, sinks and saved state: given rows are written in a format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from zonewatch import schemas
from zonewatch.catalog.base import BOXES, LOG, ZONES, query
from zonewatch.catalog.scans import PARAMS, zone_scans
from zonewatch.catalog.space import GRID, LABELLED, _labelled
from zonewatch.operators import grid as GR
from zonewatch.session import shared_dir
from zonewatch.sinks import writers as W
from zonewatch.sources import bindings as B
from zonewatch.sources import readers as RD
from zonewatch.streaming import state as ST


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("yolo_label_files", f"""WITH {BOXES} SELECT CASE WHEN image % 5 = 0 THEN 'val' ELSE 'train' END AS split, 'S_' || image || '_full' AS stem,
  CAST(image % 3 AS INTEGER) AS cls, round((x1+x2)/2/800, 6) AS cx, round((y1+y2)/2/800, 6) AS cy, round((x2-x1)/800, 6) AS w, round((y2-y1)/800, 6) AS h
FROM gt WHERE image % 3 <> 2""")
def yolo_label_files(spark, sf):
    """Label lines of all tiles through text files; the reader keeps two of the three classes."""
    labels = B.truth_boxes(spark, sf).select(
        F.when(F.col("image") % 5 == 0, "val").otherwise("train").alias("split"),
        F.concat(F.lit("S_"), F.col("image").cast("string"), F.lit("_full")).alias("stem"),
        (F.col("image") % 3).cast("int").alias("cls"), "x1", "y1", "x2", "y2")
    path = _folder(spark, "labels")
    W.write_yolo_text(labels, path, F.lit(800.0))
    return RD.read_yolo_lines(spark, path, "S", [0, 1]).select("split", "stem", "cls", "cx", "cy", "w", "h")


@query("region_csv_lookup", """WITH f AS (SELECT doc_id, 'f' || doc_id % 300 || '.jpg' AS file_name, '/data/' || source || '/f' || doc_id % 300 || '.jpg' AS path FROM documents),
p AS (SELECT file_name, min(path) AS path FROM f GROUP BY 1),
b AS (SELECT 'f' || l_orderkey % 400 || '.jpg' AS file_name, l_partkey % 90 AS x1, l_suppkey % 70 AS y1, CAST(l_partkey % 90 + l_quantity AS INTEGER) AS x2,
  CAST(l_suppkey % 70 + l_quantity AS INTEGER) AS y2 FROM lineitem WHERE l_linenumber <> 3)
SELECT file_name, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, x2, y2, path FROM b JOIN p USING (file_name)""")
def region_csv_lookup(spark, sf):
    """Boxes through a CSV file, some without whole numbers, joined to the lowest path of their name."""
    name = lambda c, n: F.concat(F.lit("f"), (F.col(c) % n).cast("string"), F.lit(".jpg"))
    listing = B.table(spark, sf, "documents").select(
        name("doc_id", 300).alias("file_name"), F.concat(F.lit("/data/"), "source", F.lit("/"), name("doc_id", 300)).alias("path"))
    x, y, q = F.col("l_partkey") % 90, F.col("l_suppkey") % 70, F.col("l_quantity").cast("int")
    broken = F.when(F.col("l_linenumber") == 3, F.lit("1.5")).otherwise((x + q).cast("string"))
    rows = B.table(spark, sf, "lineitem").select(name("l_orderkey", 400).alias("filename"), x.alias("x1"), y.alias("y1"), broken.alias("x2"), (y + q).alias("y2"))
    path = _folder(spark, "regions")
    rows.write.option("header", True).csv(path)
    return RD.read_region_csv(spark, path, listing).select("file_name", "x1", "y1", "x2", "y2", "path")


@query("zone_files", f"""WITH {ZONES} SELECT CAST(camera_id AS VARCHAR) AS camera_id, round(a, 4) AS x1, round(b, 4) AS y1, round(a+0.40::DOUBLE, 4) AS x2, round(b+0.05::DOUBLE, 4) AS y2,
  round(a+0.45::DOUBLE, 4) AS x3, round(b+0.50::DOUBLE, 4) AS y3, round(a+0.02::DOUBLE, 4) AS x4, round(b+0.45::DOUBLE, 4) AS y4 FROM zpts""")
def zone_files(spark, sf):
    """Zones through their files."""
    path = _folder(spark, "zones")
    W.write_zones(B.zones(spark, sf).withColumn("camera_id", F.col("camera_id").cast("string")), path)
    p = F.col("points")
    return RD.read_zone_lines(spark, path).select("camera_id", *[p[i][k].alias(f"{c}{i + 1}") for i in range(4) for k, c in enumerate("xy")])


@query("tile_files", f"""WITH {LABELLED}, t AS (SELECT image, tile_no, image % 5 = 0 AS held, 'S' || image % 3 AS source FROM it LEFT JOIN v USING (image, tile_no) WHERE NOT coalesce(cut, false)),
l AS (SELECT image, tile_no, count(*) AS n FROM part p JOIN v USING (image, tile_no) WHERE NOT cut AND frac >= 0.60 GROUP BY ALL)
SELECT CASE WHEN held THEN 'val' ELSE 'train' END AS split, source, count(*) AS n_tiles, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_labels FROM t LEFT JOIN l USING (image, tile_no) GROUP BY ALL""")
def tile_files(spark, sf):
    """Tiles and their labels through the dataset's folders, one per split and source."""
    tiles, labels = _labelled(spark, sf, B.image_parts(spark, sf))
    image = F.col("image")
    placed = {"split": F.when(image % 5 == 0, "val").otherwise("train"), "source": F.concat(F.lit("S"), (image % 3).cast("string")),
              "stem": F.concat_ws("_", image.cast("string"), F.col("tile_no").cast("string"))}
    path = _folder(spark, "tiles")
    W.write_tiles(tiles.withColumns(placed), labels.withColumns(placed), path)
    n = spark.read.parquet(f"{path}/labels").groupBy("split", "source", "stem").agg(F.count(F.lit(1)).alias("n"))
    back = spark.read.parquet(f"{path}/tiles")
    found = back.filter("n_labels > 0").join(n, ["split", "source", "stem"]).groupBy("split", "source").agg(F.sum("n").alias("n"))  # others have none
    tiles = back.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_tiles"))
    return tiles.join(found, ["split", "source"], "left").select("split", "source", "n_tiles", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_labels"))


@query("coco_documents", """WITH a AS (SELECT o_orderkey // 20000 AS doc, o_orderkey AS image_id, 'p/' || o_orderkey || '_' || o_orderpriority || '".jpg' AS file_name FROM orders)
SELECT 'S' AS source, a.image_id, a.file_name, CAST(l_partkey % 7 AS BIGINT) AS category_id, 'class {' || l_partkey % 7 || '}' AS name, CAST(l_partkey * 37 % 400 AS DOUBLE) AS x,
  CAST(l_quantity AS DOUBLE) AS w FROM lineitem JOIN a ON l_orderkey = a.image_id""")
def coco_documents(spark, sf):
    """Annotation documents, one for each 20 000 order numbers: written by a task each, read back in byte ranges."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    orders, lines = B.table(spark, sf, "orders"), B.table(spark, sf, "lineitem")
    doc = lambda key: F.floor(F.col(key) / 20_000).alias("doc")
    file_name = text("p/", F.col("o_orderkey"), "_", F.col("o_orderpriority"), '".jpg')
    image = F.to_json(F.struct(F.col("o_orderkey").alias("id"), file_name.alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height")))
    box = F.array((F.col("l_partkey") * 37 % 400).cast("double"), F.lit(0.0), F.col("l_quantity").cast("double"), F.lit(1.0))
    mark = F.to_json(F.struct(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 7).alias("category_id"), box.alias("bbox"),
                              F.struct(F.lit("}{").alias("counts")).alias("segmentation")))
    parts = [(orders, "o_orderkey", image), (lines, "l_orderkey", mark)]
    docs = orders.select(doc("o_orderkey")).distinct()
    line = lambda df, nth, value: df.select("doc", F.lit(nth).alias("nth"), value.alias("value"))
    rows = [line(docs, 0, F.lit('{"info": {"version": "1"}, "images": [{"id": -1}')), line(docs, 2, F.lit('], "annotations": [{"id": -1}')),
            line(docs, 4, text('], "categories": [', ", ".join(f'{{"id": {i}, "name": "class {{{i}}}"}}' for i in range(7)), "]}"))]
    rows += [line(df.select(doc(key), text(",", value).alias("v")), nth, F.col("v")) for (df, key, value), nth in zip(parts, (1, 3))]
    whole = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).unionByName(rows[4])
    path = _folder(spark, "coco")
    whole.repartition("doc").sortWithinPartitions("doc", "nth").select("doc", "value").write.partitionBy("doc").text(path)
    images, marks, names = RD.read_coco(spark, f"{path}/*/*.txt", "S")
    names = names.select("source", F.col("id").alias("category_id"), "name").distinct()
    return (marks.join(images, ["source", "image_id"]).join(names, ["source", "category_id"])
            .select("source", "image_id", "file_name", "category_id", "name", F.col("bbox")[0].alias("x"), F.col("bbox")[2].alias("w")))


@query("scan_log_files", f"""WITH {LOG} SELECT t_s, dirty, alert, n_hot, n_cells, n_changed, shift_px, nullif(hot_cells, '') AS hot_cells FROM log""")
def scan_log_files(spark, sf):
    """The scan log through CSV files with all columns; quoted cell lists hold commas."""
    log = B.scan_log(spark, sf)
    full = log.select(*[(F.col(f.name) if f.name in log.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.SCAN_LOG.fields])
    path = _folder(spark, "scans")
    full.write.option("header", True).option("quote", '"').csv(path)
    back = RD.read_scan_log(spark, path)
    return back.select("t_s", "dirty", "alert", *[F.col(c).cast("bigint").alias(c) for c in ("n_hot", "n_cells", "n_changed")], "shift_px",
                       F.array_join("cells", " ").alias("hot_cells"))


@query("state_restored", """SELECT CAST(vec_id // 125 AS VARCHAR) AS camera_id, 'z0' AS zone_id, 'g1' AS sig FROM embeddings WHERE vec_id // 125 <> 2 GROUP BY 1""")
def state_restored(spark, sf):
    """Saved states come back for the zones whose grid is still the same, known references or not."""
    scans = zone_scans(spark, sf)
    path = _folder(spark, "snapshot")
    ST.save_state(ST.final_states(scans, PARAMS), path)
    now = scans.select("camera_id", "zone_id", F.when(F.col("camera_id") == "2", "g2").otherwise(F.col("sig")).alias("sig")).distinct()
    return ST.load_state(spark, path, now).select("camera_id", "zone_id", "sig")


@query("scan_zone_cells", f"""WITH {GRID}, s AS (SELECT DISTINCT l_suppkey AS camera_id, l_linenumber AS scan_no FROM lineitem)
SELECT camera_id, scan_no, "row", col, x1, y1, x2, y2 FROM s JOIN grid USING (camera_id)""")
def scan_zone_cells(spark, sf):
    scans = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("camera_id"), F.col("l_linenumber").alias("scan_no")).distinct()
    cells = GR.build_grid(B.zones(spark, sf)).select("camera_id", "row", "col", "x1", "y1", "x2", "y2")
    return GR.scan_cells(scans, cells, ["camera_id"])


@query("reference_lookup", """WITH r AS (SELECT label AS cell, arg_min(embedding, vec_id) AS ref FROM embeddings WHERE label % 3 <> 0 GROUP BY label)
SELECT label AS cell, vec_id AS scan_no, CAST(embedding[1] AS DOUBLE) AS now, CAST(ref[1] AS DOUBLE) AS was FROM embeddings LEFT JOIN r ON r.cell = label""")
def reference_lookup(spark, sf):
    d = B.descriptors(spark, sf)
    refs = d.filter("cell % 3 != 0").groupBy("cell").agg(F.min_by("desc", "scan_no").alias("desc"))
    return GR.with_reference(d, refs, ["cell"]).select("cell", "scan_no", F.element_at("desc", 1).cast("double").alias("now"),
                                                       F.element_at("ref", 1).cast("double").alias("was"))


VERIFY = """v AS (SELECT CAST(vec_id // 125 AS VARCHAR) AS camera_id, label, row_number() OVER (PARTITION BY vec_id // 125, label ORDER BY vec_id) AS scan_no, embedding AS e FROM embeddings)"""


@query("scan_to_report", f"""WITH {VERIFY}, s AS (SELECT camera_id, scan_no, count(*) FILTER (e[2] < 0.05) AS n, max(e[5] * 2 + 0.5) FILTER (e[2] < 0.05) AS conf FROM v GROUP BY ALL)
SELECT camera_id, max(scan_no) * 30.0::DOUBLE - min(scan_no) * 30.0::DOUBLE AS span_s, count(*) AS n_scans, CAST(sum(n) AS BIGINT) AS n_boxes,
  CAST(max(conf) AS DOUBLE) AS top_conf FROM s GROUP BY camera_id""")
def scan_to_report(spark, sf):
    """Zone scan, its log, the reports on it: detections and confidence come through to the end."""
    from zonewatch.catalog.scans import zone_cells
    from zonewatch.operators.zone_scan import scan_batch
    from zonewatch.plans import runlog
    by = ["camera_id", "zone_id", "scan_no"]
    scans = zone_scans(spark, sf)
    boxes = zone_cells(spark, sf).filter("det_hit").select(*by, F.col("score").alias("conf"))
    log = runlog.scan_log(scan_batch(scans, PARAMS), scans, by, boxes)
    top = log.groupBy("camera_id").agg(F.max("verify_conf").alias("top_conf"))
    return (runlog.run_summary(log, ["camera_id"]).join(runlog.reject_share(log, ["camera_id"], ["scan_no"]), "camera_id").join(top, "camera_id")
            .select("camera_id", "span_s", "n_scans", F.col("n_boxes"), "top_conf"))
