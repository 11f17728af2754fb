"""Queries over grids, boxes, clusters and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonewatch.catalog.base import (BOXES, DAILY, ZONES, area_sql, center_sql, inside_sql, inter_sql,
                                    iou_sql, positions_sql, query, touches_sql)
from zonewatch.functions import geometry as G
from zonewatch.operators import boxes as BX
from zonewatch.operators import clusters as C
from zonewatch.operators import grid as GR
from zonewatch.operators import sampling as S
from zonewatch.operators import tiling as TL
from zonewatch.sources import bindings as B

CORNERS = ["x1", "y1", "x2", "y2"]

GRID = ZONES + f""", ys AS (SELECT *, unnest({positions_sql('by1', 'by2', 64, 32)}) AS y1,
    generate_subscripts({positions_sql('by1', 'by2', 64, 32)}, 1) - 1 AS r FROM zbox),
xs AS (SELECT *, unnest({positions_sql('bx1', 'bx2', 64, 32)}) AS x1,
    generate_subscripts({positions_sql('bx1', 'bx2', 64, 32)}, 1) - 1 AS c FROM ys),
grid AS (SELECT camera_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, CAST(x1 AS INTEGER) AS x1,
    CAST(y1 AS INTEGER) AS y1, CAST(least(640, x1+64) AS INTEGER) AS x2, CAST(least(480, y1+64) AS INTEGER) AS y2 FROM xs
  WHERE {inside_sql('((x1+least(640,x1+64))/2.0::DOUBLE)', '((y1+least(480,y1+64))/2.0::DOUBLE)')})"""


@query("grid_cells", f"WITH {GRID} SELECT * FROM grid")
def grid_cells(spark, sf):
    return GR.build_grid(B.zones(spark, sf)).drop("zone_id", "sig")


@query("grid_cell_fields", f"""WITH {GRID} SELECT camera_id, "row" || ',' || col AS cell_id,
  (x1+x2)/2.0::DOUBLE AS cx, (y1+y2)/2.0::DOUBLE AS cy, (x2-x1)*(y2-y1) AS area FROM grid""")
def grid_cell_fields(spark, sf):
    return GR.cell_fields(GR.build_grid(B.zones(spark, sf))).select("camera_id", "cell_id", "cx", "cy", "area")


@query("grid_signature", f"""WITH {ZONES} SELECT camera_id, substr(sha1('640x480|c64|o0.50|' || px1||','||py1||'|'||
  px2||','||py2||'|'||px3||','||py3||'|'||px4||','||py4), 1, 16) AS sig, bx1, by1, bx2, by2 FROM zbox""")
def grid_signature(spark, sf):
    return GR.zone_layout(B.zones(spark, sf)).select("camera_id", "sig", "bx1", "by1", "bx2", "by2")


@query("zone_preview", f"""WITH {GRID} SELECT camera_id, count(*) AS n_cells, 32 AS min_object_px
FROM grid GROUP BY camera_id""")
def zone_preview(spark, sf):
    return GR.zone_preview(B.zones(spark, sf)).drop("zone_id", "sig")


@query("points_in_zone", f"""WITH {ZONES}, p AS (SELECT l_suppkey AS camera_id, l_partkey*37 % 640 + 0.5::DOUBLE AS px,
  l_orderkey*11 % 480 + 0.5::DOUBLE AS py FROM lineitem)
SELECT camera_id, count(*) AS n_points, count(*) FILTER ({inside_sql('px', 'py')}) AS n_inside
FROM p JOIN zpoly USING (camera_id) GROUP BY camera_id""")
def points_in_zone(spark, sf):
    z = GR.zone_layout(B.zones(spark, sf)).select("camera_id", "poly")
    inside = G.point_in_polygon(F.col("px"), F.col("py"), F.col("poly"))
    return (B.zone_points(spark, sf).join(z, "camera_id").groupBy("camera_id")
            .agg(F.count(F.lit(1)).alias("n_points"), F.count_if(inside).alias("n_inside")))


OCCL = """occ AS (SELECT l_suppkey AS camera_id, CAST(l_partkey*37 % 400 AS DOUBLE) AS x1,
  CAST(l_orderkey*53 % 300 AS DOUBLE) AS y1, CAST(l_partkey*37 % 400 + l_quantity AS DOUBLE) AS x2,
  CAST(l_orderkey*53 % 300 + l_quantity*2 AS DOUBLE) AS y2 FROM lineitem)"""


def _occluders(spark, sf):
    x1, y1 = F.col("l_partkey") * 37 % 400, F.col("l_orderkey") * 53 % 300
    return (B.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("camera_id"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
        (x1 + F.col("l_quantity")).cast("double").alias("x2"),
        (y1 + F.col("l_quantity") * 2).cast("double").alias("y2")))


@query("occluded_cells", f"""WITH {GRID}, {OCCL}, pad AS (SELECT camera_id, x1-8 AS x1, y1-8 AS y1, x2+8 AS x2, y2+8 AS y2 FROM occ)
SELECT DISTINCT g.camera_id, g."row", g.col FROM grid g JOIN pad o USING (camera_id)
WHERE {inter_sql('g', 'o')}/{area_sql('g')} >= 0.3""")
def occluded_cells(spark, sf):
    cells = GR.build_grid(B.zones(spark, sf))
    return GR.occluded_cells(cells, _occluders(spark, sf), ["camera_id"], 0.3, 8).select("camera_id", "row", "col")


@query("visible_cells", f"""WITH {GRID}, {OCCL}, hid AS (
  SELECT DISTINCT g.camera_id, g."row", g.col FROM grid g JOIN occ o USING (camera_id)
  WHERE {inter_sql('g', 'o')}/{area_sql('g')} >= 0.3)
SELECT camera_id, count(*) AS n_live FROM grid g WHERE NOT EXISTS
  (SELECT 1 FROM hid h WHERE h.camera_id=g.camera_id AND h."row"=g."row" AND h.col=g.col) GROUP BY camera_id""")
def visible_cells(spark, sf):
    live = GR.drop_occluded(GR.build_grid(B.zones(spark, sf)), _occluders(spark, sf), ["camera_id"], 0.3, 0.0)
    return live.groupBy("camera_id").agg(F.count(F.lit(1)).alias("n_live"))


@query("verify_semi", f"""WITH {GRID}, {OCCL} SELECT DISTINCT g.camera_id, g."row", g.col
FROM grid g JOIN occ o USING (camera_id) WHERE {touches_sql('g', 'o')}""")
def verify_semi(spark, sf):
    cells = GR.build_grid(B.zones(spark, sf))
    return GR.verified_cells(cells, _occluders(spark, sf), ["camera_id"]).select("camera_id", "row", "col")


@query("gt_hits", f"""WITH {BOXES} SELECT image, x1, y1, x2, y2,
  EXISTS (SELECT 1 FROM det d WHERE d.image=g.image AND {center_sql('d', 'g')}) AS hit FROM gt g""")
def gt_hits(spark, sf):
    return BX.match_gt(B.truth_boxes(spark, sf), B.detections(spark, sf), ["image"], CORNERS)


@query("gt_hits_either", f"""WITH {BOXES} SELECT count(*) AS n_gt, count(*) FILTER (hit) AS n_hit FROM (
SELECT EXISTS (SELECT 1 FROM det d WHERE d.image=g.image AND ({center_sql('d', 'g')} OR {iou_sql('d', 'g')} >= 0.3)) AS hit FROM gt g)""")
def gt_hits_either(spark, sf):
    m = BX.match_gt(B.truth_boxes(spark, sf), B.detections(spark, sf), ["image"], CORNERS, mode="either")
    return m.agg(F.count(F.lit(1)).alias("n_gt"), F.count_if("hit").alias("n_hit"))


@query("iou_pairs", f"""WITH {BOXES}, u AS (SELECT DISTINCT image,x1,y1,x2,y2 FROM boxes)
SELECT a.image, a.x1 AS a_x1, a.y1 AS a_y1, b.x1 AS b_x1, b.y1 AS b_y1, {iou_sql('a', 'b')} AS iou
FROM u a JOIN u b ON a.image=b.image AND (a.x1,a.y1,a.x2,a.y2) < (b.x1,b.y1,b.x2,b.y2)
WHERE {touches_sql('a', 'b')} AND {iou_sql('a', 'b')} > 0.3""")
def iou_pairs(spark, sf):
    u = B.boxes(spark, sf).select("image", *CORNERS).distinct()
    return BX.iou_pairs(u, ["image"], CORNERS, 0.3).select("image", "a_x1", "a_y1", "b_x1", "b_y1", "iou")


@query("extra_boxes", f"""WITH {BOXES}, n AS (SELECT image, sum(d) AS d, sum(g) AS g FROM (
    SELECT image, 1 AS d, 0 AS g FROM det UNION ALL SELECT image, 0, 1 FROM gt) GROUP BY image),
m AS (SELECT g.image, g.x1, g.y1, g.x2, g.y2, min((-d.score, d.x1, d.y1, d.x2, d.y2)) AS k
  FROM gt g JOIN det d ON d.image=g.image AND {touches_sql('d', 'g')} AND ({center_sql('d', 'g')} OR {iou_sql('d', 'g')} >= 0.3)
  GROUP BY ALL)
SELECT 'per_frame' AS mode, CAST(sum(greatest(0, d-g)) AS BIGINT) AS extra FROM n
UNION ALL SELECT 'total', CAST(greatest(0, sum(d)-sum(g)) AS BIGINT) FROM n
UNION ALL SELECT 'off_target', count(*) FROM det d WHERE NOT EXISTS (SELECT 1 FROM gt g WHERE g.image=d.image AND {center_sql('d', 'g')})
UNION ALL SELECT 'unmatched', count(*) FROM det d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.image=d.image
  AND m.k = (-d.score, d.x1, d.y1, d.x2, d.y2))""")
def extra_boxes(spark, sf):
    gt, det = B.truth_boxes(spark, sf), B.detections(spark, sf)
    out = None
    for mode in ("per_frame", "total", "off_target", "unmatched"):
        one = BX.extra_boxes(gt, det, ["image"], mode).select(F.lit(mode).alias("mode"), F.col("extra").cast("bigint"))
        out = one if out is None else out.unionByName(one)
    return out


@query("nms", f"""WITH RECURSIVE {BOXES}, b AS (
  SELECT *, row_number() OVER (PARTITION BY image ORDER BY -score, x1, y1, x2, y2) AS rn
  FROM (SELECT DISTINCT image, x1, y1, x2, y2, score FROM boxes)),
run AS (
  SELECT image, rn, x1, y1, x2, y2, score, true AS keep, [{{'x1':x1,'y1':y1,'x2':x2,'y2':y2}}] AS kept FROM b WHERE rn = 1
  UNION ALL
  SELECT n.image, n.rn, n.x1, n.y1, n.x2, n.y2, n.score, z.ok,
    CASE WHEN z.ok THEN list_append(r.kept, {{'x1':n.x1,'y1':n.y1,'x2':n.x2,'y2':n.y2}}) ELSE r.kept END
  FROM run r JOIN b n ON n.image = r.image AND n.rn = r.rn + 1,
  LATERAL (SELECT len(list_filter(r.kept, lambda k: greatest(least(k.x2,n.x2)-greatest(k.x1,n.x1),0)
     *greatest(least(k.y2,n.y2)-greatest(k.y1,n.y1),0) / ((k.x2-k.x1)*(k.y2-k.y1)+(n.x2-n.x1)*(n.y2-n.y1)
     -greatest(least(k.x2,n.x2)-greatest(k.x1,n.x1),0)*greatest(least(k.y2,n.y2)-greatest(k.y1,n.y1),0)+1e-9) > 0.5)) = 0 AS ok) z)
SELECT image, x1, y1, x2, y2, score FROM run WHERE keep""")
def nms(spark, sf):
    b = B.boxes(spark, sf).select("image", *CORNERS, "score")
    return BX.nms(b, ["image"], 0.5)


@query("cell_neighbors", f"""WITH {DAILY} SELECT a.zone, a.day, count(*) AS n_pairs FROM daily a JOIN daily b
ON a.zone=b.zone AND a.day=b.day AND (a."row",a.col) <> (b."row",b.col) AND abs(a."row"-b."row") <= 1 AND abs(a.col-b.col) <= 1
GROUP BY ALL""")
def cell_neighbors(spark, sf):
    return (GR.neighbors(B.daily_cells(spark, sf), ["zone", "day"]).groupBy("zone", "day")
            .agg(F.count(F.lit(1)).alias("n_pairs")))


COMP = DAILY.replace("obs AS", "obs AS", 1) + """, reach AS (
  SELECT zone, day, "row" AS r0, col AS c0, "row", col FROM daily
  UNION
  SELECT p.zone, p.day, p.r0, p.c0, d."row", d.col FROM reach p JOIN daily d ON d.zone=p.zone AND d.day=p.day
    AND abs(d."row"-p."row") <= 1 AND abs(d.col-p.col) <= 1),
comp AS (SELECT zone, day, "row", col, min((r0, c0)) AS low FROM reach GROUP BY ALL),
clus AS (SELECT zone, day, struct_extract(low, 1) AS comp_row, struct_extract(low, 2) AS comp_col,
  count(*) AS n_cells, min(col*32) AS x1, min("row"*32) AS y1, max(col*32+64) AS x2, max("row"*32+64) AS y2
  FROM comp GROUP BY ALL)"""


@query("cell_components", f"""WITH RECURSIVE {COMP} SELECT zone, day, "row", col,
  struct_extract(low, 1) AS comp_row, struct_extract(low, 2) AS comp_col FROM comp""")
def cell_components(spark, sf):
    return C.components(B.daily_cells(spark, sf), ["zone", "day"])


LARGE_MASK = """m AS (SELECT DISTINCT CAST(o_custkey AS INTEGER) AS "row", CAST(o_orderkey * 37 % 61 AS INTEGER) AS col FROM orders),
reach AS (SELECT "row" AS r0, col AS c0, "row", col FROM m
  UNION SELECT p.r0, p.c0, d."row", d.col FROM reach p JOIN m d ON d."row" BETWEEN p."row" - 1 AND p."row" + 1 AND d.col BETWEEN p.col - 1 AND p.col + 1)"""


@query("large_mask_components", f"""WITH RECURSIVE {LARGE_MASK} SELECT 0 AS scan, "row", col, struct_extract(min((r0, c0)), 1) AS comp_row,
  struct_extract(min((r0, c0)), 2) AS comp_col FROM reach GROUP BY ALL""")
def large_mask_components(spark, sf):
    """orders -> the cells of one mask, which grows with the table; labelled in blocks of 64 x 64 cells."""
    mask = B.table(spark, sf, "orders").select(F.lit(0).alias("scan"), F.col("o_custkey").cast("int").alias("row"),
                                              (F.col("o_orderkey") * 37 % 61).cast("int").alias("col")).distinct()
    return C.components_by_blocks(mask, ["scan"], 1, 64)


def _clusters(spark, sf):
    cells = B.daily_cells(spark, sf)
    comp = C.components(cells, ["zone", "day"])
    return C.hot_hull(cells.join(comp, ["zone", "day", "row", "col"]), ["zone", "day", "comp_row", "comp_col"])


@query("cluster_regions", f"""WITH RECURSIVE {COMP}, top AS (SELECT *, row_number() OVER (PARTITION BY zone, day
    ORDER BY n_cells DESC, comp_row, comp_col) AS rn FROM clus),
s AS (SELECT *, least(320, greatest(160, x2-x1+96, y2-y1+96)) AS side, (x1+x2)/2.0 AS cx, (y1+y2)/2.0 AS cy FROM top WHERE rn <= 3),
o AS (SELECT *, CAST(trunc(greatest(0, least(640-side, cx-side/2.0))) AS INTEGER) AS rx1,
       CAST(trunc(greatest(0, least(480-side, cy-side/2.0))) AS INTEGER) AS ry1 FROM s)
SELECT zone, day, comp_row, comp_col, n_cells, rx1, ry1, CAST(least(640, rx1+side) AS INTEGER) AS rx2,
  CAST(least(480, ry1+side) AS INTEGER) AS ry2 FROM o""")
def cluster_regions(spark, sf):
    top = C.largest_clusters(_clusters(spark, sf), 3, ["zone", "day"])
    framed = top.withColumns({"frame_w": F.lit(640), "frame_h": F.lit(480)})
    return C.cluster_regions(framed, 48, 160, 320).select("zone", "day", "comp_row", "comp_col", "n_cells",
                                                          "rx1", "ry1", "rx2", "ry2")


def _tiles_sql(src: str, keys: str, side: int, step: int) -> str:
    px, py = positions_sql("ax1", "ax2", side, step), positions_sql("ay1", "ay2", side, step)
    return f"""ty AS (SELECT *, unnest({py}) AS ty1, generate_subscripts({py}, 1) - 1 AS iy FROM {src}),
tx AS (SELECT *, unnest({px}) AS tx1, generate_subscripts({px}, 1) - 1 AS ix, len({px}) AS nx FROM ty),
tiles AS (SELECT {keys}, CAST(iy*nx+ix AS INTEGER) AS tile_no, tx1, ty1, least(640, tx1+{side}) AS tx2, least(480, ty1+{side}) AS ty2 FROM tx)"""


@query("cover_tiles", f"""WITH RECURSIVE {COMP}, a AS (SELECT *, greatest(0,x1-48) AS ax1, greatest(0,y1-48) AS ay1,
  least(640,x2+48) AS ax2, least(480,y2+48) AS ay2 FROM clus), {_tiles_sql('a', 'zone, day, comp_row, comp_col', 128, 64)}
SELECT * FROM tiles""")
def cover_tiles(spark, sf):
    c = _clusters(spark, sf).withColumns({"frame_w": F.lit(640), "frame_h": F.lit(480)})
    return C.cover_tiles(c, 0.4).select("zone", "day", "comp_row", "comp_col", "tile_no", "tx1", "ty1", "tx2", "ty2")


SWEEP = GRID + f""", a AS (SELECT camera_id, greatest(0,min(x1)-48) AS ax1, greatest(0,min(y1)-48) AS ay1,
  least(640,max(x2)+48) AS ax2, least(480,max(y2)+48) AS ay2 FROM grid GROUP BY camera_id), {_tiles_sql('a', 'camera_id', 128, 64)}"""


def _sweep(spark, sf):
    cells = GR.build_grid(B.zones(spark, sf))
    hull = C.hot_hull(cells, ["camera_id"]).withColumns({"frame_w": F.lit(640), "frame_h": F.lit(480)})
    return C.sweep_tiles(hull, 320, 0.4).select("camera_id", "tile_no", "tx1", "ty1", "tx2", "ty2")


@query("sweep_tiles", f"WITH {SWEEP} SELECT * FROM tiles")
def sweep_tiles(spark, sf):
    return _sweep(spark, sf)


@query("tile_decimation", f"""WITH {SWEEP}, n AS (SELECT *, count(*) OVER (PARTITION BY camera_id) AS n,
  row_number() OVER (PARTITION BY camera_id ORDER BY tile_no) - 1 AS i FROM tiles)
SELECT camera_id, tile_no, n, least(ceil(n/ceil(n/12)), 12)::BIGINT AS n_kept FROM n
WHERE i % ceil(n/12) = 0 AND i / ceil(n/12) < 12""")
def tile_decimation(spark, sf):
    return C.thin(_sweep(spark, sf), 12, ["camera_id"], ["tile_no"]).select("camera_id", "tile_no", "n", "n_kept")


IMG = """img AS (SELECT o_orderkey AS image, CAST(500 + o_custkey*7 % 900 AS INTEGER) AS width,
  CAST(300 + o_custkey*3 % 500 AS INTEGER) AS height FROM orders)"""


def _images(spark, sf):
    return B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image"), (F.lit(500) + F.col("o_custkey") * 7 % 900).cast("int").alias("width"),
        (F.lit(300) + F.col("o_custkey") * 3 % 500).cast("int").alias("height"))


ITILES = IMG + f""", iy AS (SELECT *, unnest({positions_sql('0', 'height', 320, 160)}) AS y1,
    generate_subscripts({positions_sql('0', 'height', 320, 160)}, 1) - 1 AS r FROM img),
ix AS (SELECT *, unnest({positions_sql('0', 'width', 320, 160)}) AS x1, len({positions_sql('0', 'width', 320, 160)}) AS nx,
    generate_subscripts({positions_sql('0', 'width', 320, 160)}, 1) - 1 AS c FROM iy),
it AS (SELECT image, CAST(r*nx+c AS INTEGER) AS tile_no, x1, y1, least(width, x1+320) AS x2, least(height, y1+320) AS y2 FROM ix)"""


@query("image_tiles", f"WITH {ITILES} SELECT image, tile_no, x1, y1, x2, y2 FROM it")
def image_tiles(spark, sf):
    return TL.image_tiles(_images(spark, sf), 320, 0.5).select("image", "tile_no", "x1", "y1", "x2", "y2")


LABELLED = f"""{ITILES}, {BOXES}, u AS (SELECT DISTINCT image,x1,y1,x2,y2 FROM boxes),
part AS (SELECT t.image, t.tile_no, t.x1 AS tx, t.y1 AS ty, u.x1, u.y1, u.x2, u.y2, t.x2 AS tx2, t.y2 AS ty2,
   {inter_sql('u', 't')}/greatest(1e-9, {area_sql('u')}) AS frac FROM it t JOIN u ON u.image=t.image AND {touches_sql('u', 't')}),
v AS (SELECT image, tile_no, bool_or(frac > 0.10 AND frac < 0.60) AS cut, count(*) FILTER (frac >= 0.60) AS n_labels FROM part GROUP BY ALL)"""


def _labelled(spark, sf, parts=None):
    """With `parts`, images and boxes are dealt out by image once, and all steps up to the labels go image by image."""
    images = _images(spark, sf)
    images = images.repartition(parts, "image") if parts else images
    boxes = B.boxes(spark, sf, parts).select("image", *CORNERS).distinct().join(images, "image")
    return TL.label_tiles(images, boxes, ["image"], 320, 0.5)


@query("tile_labels", f"""WITH {LABELLED} SELECT p.image, p.tile_no, greatest(x1,tx)-tx AS x1, greatest(y1,ty)-ty AS y1,
  least(x2,tx2)-tx AS x2, least(y2,ty2)-ty AS y2 FROM part p JOIN v USING (image, tile_no) WHERE NOT cut AND frac >= 0.60""")
def tile_labels(spark, sf):
    return _labelled(spark, sf, B.image_parts(spark, sf))[1]


@query("tile_kinds", f"""WITH {LABELLED} SELECT coalesce(n_labels,0) AS n_labels, count(*) AS n_tiles
FROM it LEFT JOIN v USING (image, tile_no) WHERE NOT coalesce(cut,false) GROUP BY ALL""")
def tile_kinds(spark, sf):
    return _labelled(spark, sf, B.image_parts(spark, sf))[0].groupBy("n_labels").agg(F.count(F.lit(1)).alias("n_tiles"))


@query("negatives_per_image", f"""WITH {LABELLED}, e AS (SELECT image, tile_no,
  row_number() OVER (PARTITION BY image ORDER BY md5('0|' || image || '|' || tile_no), tile_no) AS rn
  FROM it LEFT JOIN v USING (image, tile_no) WHERE NOT coalesce(cut,false) AND coalesce(n_labels,0) = 0)
SELECT image, tile_no FROM e WHERE rn <= 2""")
def negatives_per_image(spark, sf):
    empty = _labelled(spark, sf, B.image_parts(spark, sf))[0].filter("n_labels = 0")
    return TL.pick_negatives(empty, 2, ["image"]).select("image", "tile_no")


ZT = ZONES + f""", a AS (SELECT *, bx1 AS ax1, by1 AS ay1, bx2 AS ax2, by2 AS ay2 FROM zbox
  WHERE bx2-bx1 >= 8 AND by2-by1 >= 8), {_tiles_sql('a', 'camera_id', 160, 120)}"""


@query("zone_tiles", f"""WITH {ZT} SELECT camera_id, tile_no, tx1, ty1, tx2, ty2,
  CASE WHEN greatest(tx2-tx1, ty2-ty1)*4.0 > 600 THEN 600/greatest(tx2-tx1, ty2-ty1) ELSE 4.0::DOUBLE END::DOUBLE AS scale FROM tiles""")
def zone_tiles(spark, sf):
    z = GR.zone_layout(B.zones(spark, sf))
    return TL.zone_tiles(z, 160, 0.25, 4.0, 600).select("camera_id", "tile_no", "tx1", "ty1", "tx2", "ty2", "scale")


@query("tile_to_frame", f"""WITH {ZT}, d AS (SELECT l_suppkey AS camera_id, l_partkey % 100 AS bx, l_orderkey % 90 AS by_,
  l_quantity AS bw FROM lineitem)
SELECT camera_id, tile_no, count(*) AS n, sum(tx1 + bx/2.0::DOUBLE) AS sx, sum(ty1 + (by_+bw)/2.0::DOUBLE) AS sy
FROM tiles JOIN d USING (camera_id) GROUP BY camera_id, tile_no""")
def tile_to_frame(spark, sf):
    z = GR.zone_layout(B.zones(spark, sf))
    t = TL.zone_tiles(z, 160, 0.25).select("camera_id", "tile_no", "tx1", "ty1")
    d = B.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("camera_id"), (F.col("l_partkey") % 100).alias("x1"),
        (F.col("l_orderkey") % 90).alias("y1"), (F.col("l_partkey") % 100 + F.col("l_quantity")).alias("x2"),
        (F.col("l_orderkey") % 90 + F.col("l_quantity")).alias("y2")).join(t, "camera_id")
    f = G.to_frame(G.box(), F.col("tx1"), F.col("ty1"), F.lit(2.0))
    return d.groupBy("camera_id", "tile_no").agg(F.count(F.lit(1)).alias("n"), F.sum(f.x1).alias("sx"), F.sum(f.y2).alias("sy"))


@query("zone_detections", f"""WITH {ZONES}, {OCCL} SELECT o.camera_id, o.x1, o.y1, o.x2, o.y2 FROM occ o JOIN zpoly USING (camera_id)
WHERE {inside_sql('((o.x1+o.x2)/2.0::DOUBLE)', 'o.y2')}""")
def zone_detections(spark, sf):
    z = GR.zone_layout(B.zones(spark, sf)).select("camera_id", "poly")
    return (_occluders(spark, sf).join(z, "camera_id")
            .filter(G.bottom_center_in(G.box(), F.col("poly"))).drop("poly"))


@query("largest_object", f"""WITH {BOXES}, u AS (SELECT DISTINCT image,x1,y1,x2,y2 FROM boxes),
r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY (x2-x1)*(y2-y1) DESC, x1, y1, x2) AS rn FROM u)
SELECT image, x1, y1, x2, y2 FROM r WHERE rn = 1""")
def largest_object(spark, sf):
    return S.largest_object(B.boxes(spark, sf).select("image", *CORNERS).distinct(), ["image"])


@query("top_frames", f"""WITH {BOXES} SELECT image, count(*) AS n_objects FROM gt GROUP BY image
ORDER BY n_objects DESC, image LIMIT 20""")
def top_frames(spark, sf):
    return S.top_frames(B.truth_boxes(spark, sf), 20, "image")


@query("hot_hull", f"""WITH {DAILY} SELECT zone, day, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2,
  count(*) AS n_cells FROM cells GROUP BY ALL""")
def hot_hull(spark, sf):
    return C.hot_hull(B.daily_cells(spark, sf), ["zone", "day"])


@query("cells_on_person", f"""WITH {GRID}, {OCCL}, f AS (SELECT g.*, EXISTS (SELECT 1 FROM occ o WHERE o.camera_id=g.camera_id
   AND {center_sql('g', 'o')}) AS on_person FROM grid g)
SELECT camera_id, count(*) FILTER (on_person) AS n_on, count(*) FILTER (NOT on_person) AS n_elsewhere FROM f GROUP BY camera_id""")
def cells_on_person(spark, sf):
    cells = GR.build_grid(B.zones(spark, sf))
    person = _occluders(spark, sf).select("camera_id", *G.box().named("r_"))
    on = BX.touched(cells, person, ["camera_id"], ["row", "col"], lambda c, p: G.center_in(c, p))
    return (BX.with_flag(cells, on, ["camera_id", "row", "col"], "on_person").groupBy("camera_id").agg(
        F.count_if("on_person").alias("n_on"), F.count_if(~F.col("on_person")).alias("n_elsewhere")))
