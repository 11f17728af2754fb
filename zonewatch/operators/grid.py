"""Cell grids over polygon zones, and what hides or confirms their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewatch.functions import geometry as G
from zonewatch.operators.boxes import touched, with_flag


def zone_layout(zones: DataFrame, cell_px=64, overlap: float = 0.5) -> DataFrame:
    """Pixel polygon, clipped bounds, step and signature of each zone.

    `zones` has points (normalised), frame_w, frame_h; cell_px may be a column name.
    """
    cell = F.col(cell_px) if isinstance(cell_px, str) else F.lit(int(cell_px))
    over = F.least(F.greatest(F.lit(float(overlap)), F.lit(0.0)), F.lit(0.9))
    w, h = F.col("frame_w"), F.col("frame_h")
    out = (zones.withColumn("cell_px", F.greatest(cell.cast("int"), F.lit(8)))
           .withColumn("poly", G.poly_to_px(F.col("points"), w, h)))
    hull = G.polygon_bbox(F.col("poly"))
    out = out.withColumns({
        "bx1": F.greatest(hull.x1, F.lit(0)), "by1": F.greatest(hull.y1, F.lit(0)),
        "bx2": F.least(hull.x2, w), "by2": F.least(hull.y2, h),
        "step": G.cell_step(F.col("cell_px"), over)})
    usable = (F.size("points") >= 3) & (F.col("bx2") - F.col("bx1") >= 2) & (F.col("by2") - F.col("by1") >= 2)
    signature = G.grid_signature(F.col("poly"), w, h, F.col("cell_px"), over)
    checked = F.when(usable, signature).otherwise(
        F.raise_error(F.lit("a zone needs 3 points and 2 px of extent inside the frame")))
    return out.withColumn("sig", checked)


def build_grid(zones: DataFrame, cell_px=64, overlap: float = 0.5) -> DataFrame:
    """One row per kept cell; rows and columns keep their lattice numbers."""
    lay = zone_layout(zones, cell_px, overlap)
    cell, step = F.col("cell_px"), F.col("step")
    keys = [c for c in ("camera_id", "zone_id") if c in zones.columns]
    cells = (lay.select(*keys, "sig", "poly", "cell_px", "step", "frame_w", "frame_h", "bx1", "bx2",
                        F.posexplode(G.axis_positions(F.col("by1"), F.col("by2"), cell, step))
                        .alias("row", "y1"))
             .select("*", F.posexplode(G.axis_positions(F.col("bx1"), F.col("bx2"), cell, step))
                     .alias("col", "x1")))
    cells = cells.withColumns({"x2": F.least(F.col("frame_w"), F.col("x1") + cell),
                               "y2": F.least(F.col("frame_h"), F.col("y1") + cell)})
    b = G.box()
    return (cells.filter(G.point_in_polygon(b.cx, b.cy, F.col("poly")))
            .select(*keys, "sig", "row", "col", *b))


def cell_fields(cells: DataFrame) -> DataFrame:
    b = G.box()
    return cells.withColumns({"cell_id": F.concat_ws(",", "row", "col"), "cx": b.cx, "cy": b.cy,
                              "area": b.area})


def zone_preview(zones: DataFrame, cell_px: int = 64, overlap: float = 0.5) -> DataFrame:
    """Cells per zone and the smallest object they can catch (half a cell)."""
    keys = [c for c in ("camera_id", "zone_id") if c in zones.columns]
    return (build_grid(zones, cell_px, overlap).groupBy(*keys, "sig")
            .agg(F.count(F.lit(1)).alias("n_cells"))
            .withColumn("min_object_px", F.lit(cell_px // 2)))


def scan_cells(scans: DataFrame, cells: DataFrame, by=("camera_id", "zone_id")) -> DataFrame:
    """Every scan with every cell of its zone (equi-join; Spark picks the strategy)."""
    return scans.join(cells, list(by))


def occluded_cells(cells: DataFrame, occluders: DataFrame, by: list[str], thr: float = 0.3,
                   pad: float = 0.0) -> DataFrame:
    """Cells of which one padded occluder covers `thr` or more of the area."""
    boxes = occluders.select(*by, *G.box().padded(pad).named("r_"))
    return touched(cells, boxes, by, ["row", "col"],
                   lambda c, o: (G.overlap_frac(c, o) >= thr))


def mark_occluded(cells: DataFrame, occluders: DataFrame, by: list[str], thr: float = 0.3,
                  pad: float = 0.0) -> DataFrame:
    """Adds `visible`; hidden cells are unknown, neither clean nor dirty."""
    hidden = occluded_cells(cells, occluders, by, thr, pad)
    return (with_flag(cells, hidden, [*by, "row", "col"], "_hidden")
            .withColumn("visible", ~F.col("_hidden")).drop("_hidden"))


def drop_occluded(cells: DataFrame, occluders: DataFrame, by: list[str], thr: float = 0.3,
                  pad: float = 0.0) -> DataFrame:
    hidden = occluded_cells(cells, occluders, by, thr, pad).select(*by, "row", "col")
    return cells.join(hidden, [*by, "row", "col"], "left_anti")


def verified_cells(hot: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """Hot cells that some detection box of the scan intersects."""
    det = boxes.select(*by, *G.box().named("r_"))
    return touched(hot, det, by, ["row", "col"], G.intersects)


def points_in_zones(points: DataFrame, zones: DataFrame, by: list[str]) -> DataFrame:
    """Points (px, py) inside the polygon of their zone."""
    return (points.join(zones, by)
            .filter(G.point_in_polygon(F.col("px"), F.col("py"), F.col("poly"))))


def neighbors(cells: DataFrame, by: list[str], gap: int = 1) -> DataFrame:
    """Pairs of cells of one scan within Chebyshev distance `gap`, by an equi-join."""
    off = F.sequence(F.lit(-gap), F.lit(gap))
    spread = (cells.select(*by, "row", "col").withColumn("_dr", F.explode(off))
              .withColumn("_dc", F.explode(off)).filter("_dr != 0 or _dc != 0")
              .select(*by, F.col("row").alias("from_row"), F.col("col").alias("from_col"),
                      (F.col("row") + F.col("_dr")).alias("row"),
                      (F.col("col") + F.col("_dc")).alias("col")))
    return spread.join(cells.select(*by, "row", "col"), [*by, "row", "col"])


def fresh_cells(hot: DataFrame, latched: DataFrame, by: list[str], radius: int = 2) -> DataFrame:
    """Hot cells with no latched cell within `radius`."""
    off = F.sequence(F.lit(-radius), F.lit(radius))
    halo = (latched.select(*by, "row", "col").withColumn("_dr", F.explode(off))
            .withColumn("_dc", F.explode(off))
            .select(*by, (F.col("row") + F.col("_dr")).alias("row"),
                    (F.col("col") + F.col("_dc")).alias("col")).distinct())
    return hot.join(halo, [*by, "row", "col"], "left_anti")


def with_reference(cells: DataFrame, refs: DataFrame,
                   by=("camera_id", "zone_id", "sig", "row", "col")) -> DataFrame:
    """Current descriptors with their reference, NULL where none is known."""
    return cells.join(refs.select(*by, F.col("desc").alias("ref")), list(by), "left")


def global_change(cells: DataFrame, by: list[str], frac: float = 0.45, spread: float = 0.8,
                  min_visible: float = 0.6) -> DataFrame:
    """Whether a scan's change is one of the whole scene.

    `cells` has row, col, visible, known, changed. Distinct rows and columns are reduced
    with a first aggregation per line, so no task sees all cells of a large scan.
    """
    seen = F.col("visible") & F.col("known")
    hit = seen & F.col("changed")
    grid = cells.groupBy(*by, "row", "col").agg(
        F.max(seen).alias("seen"), F.max(hit).alias("hit"))
    per = lambda line: (grid.groupBy(*by, line).agg(
        F.sum(F.col("seen").cast("int")).alias("seen"), F.sum(F.col("hit").cast("int")).alias("hit"),
        F.count(F.lit(1)).alias("cells")).groupBy(*by).agg(
        F.sum("cells").alias("n_cells"), F.sum("seen").alias("known"), F.sum("hit").alias("changed"),
        F.count_if(F.col("seen") > 0).alias("lines"), F.count_if(F.col("hit") > 0).alias("hit_lines")))
    rows = per("row")
    cols = per("col").select(*by, F.col("lines").alias("c_lines"), F.col("hit_lines").alias("c_hit"))
    out = rows.join(cols, by)
    share = F.least(F.col("hit_lines") / F.greatest(F.lit(1), "lines"),
                    F.col("c_hit") / F.greatest(F.lit(1), "c_lines"))
    fires = ((F.col("known") >= F.greatest(F.lit(8.0), min_visible * F.col("n_cells")))
             & (F.col("changed") >= frac * F.col("known")) & (F.col("spread") >= spread))
    return (out.withColumn("spread", share).withColumn("fires", fires)
            .select(*by, "n_cells", "known", "changed", "spread", "fires"))
