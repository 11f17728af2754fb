"""Geometry as column expressions: polygons, boxes, cells."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """Four corner columns; plain columns keep the plan free of struct building."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2.0

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2.0

    def padded(self, pad: float) -> "Box":
        return Box(self.x1 - pad, self.y1 - pad, self.x2 + pad, self.y2 + pad)

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for n, c in zip(("x1", "y1", "x2", "y2"), self)]


def box(prefix: str = "", suffix: str = "") -> Box:
    """The box held by columns <prefix>x1<suffix> .. <prefix>y2<suffix>."""
    return Box(*[F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2")])


# --- polygons ---------------------------------------------------------------------

def poly_to_px(points: Column, w: Column | int, h: Column | int) -> Column:
    """Normalised vertices to whole pixels (half to even)."""
    w, h = F.lit(w) if isinstance(w, int) else w, F.lit(h) if isinstance(h, int) else h
    return F.transform(points, lambda p: F.array(
        F.bround(p[0] * w).cast("int"), F.bround(p[1] * h).cast("int")))


UNROLLED = 8  # polygons up to this many vertices are tested without array lambdas


def _crossing(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Whether the edge a-b lies right of the point at its height."""
    ax, ay = a[0].cast("double"), a[1].cast("double")
    bx, by = b[0].cast("double"), b[1].cast("double")
    # the division is only reached where the edge spans y, so its height is not 0
    meets = x < (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax
    return F.when((ay > y) != (by > y), meets).otherwise(F.lit(False))


def point_in_polygon(x: Column, y: Column, poly: Column) -> Column:
    """Even-odd rule over the edges; fewer than three vertices contain nothing.

    Small polygons are a flat expression, which Spark compiles; only larger ones need a
    lambda over their edges.
    """
    n = F.size(poly)
    flat = F.lit(False)
    for i in range(UNROLLED):
        nxt = F.get(poly, F.when(n == i + 1, F.lit(0)).otherwise(F.lit(i + 1)))
        flat = flat != F.when(n > i, _crossing(F.get(poly, F.lit(i)), nxt, x, y)).otherwise(F.lit(False))
    turned = F.concat(F.slice(poly, 2, F.greatest(n - 1, F.lit(0))), F.slice(poly, 1, 1))
    edges = F.arrays_zip(poly.alias("a"), turned.alias("b"))
    folded = F.aggregate(edges, F.lit(False), lambda inside, e: inside != _crossing(e["a"], e["b"], x, y))
    return F.when(n < 3, F.lit(False)).when(n <= UNROLLED, flat).otherwise(folded)


def polygon_bbox(poly: Column) -> Box:
    xs = F.transform(poly, lambda p: p[0])
    ys = F.transform(poly, lambda p: p[1])
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def bottom_center_in(b: Box, poly: Column) -> Column:
    return point_in_polygon(b.cx, b.y2.cast("double"), poly)


# --- boxes ------------------------------------------------------------------------

def intersection_area(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def overlap_frac(cell: Box, b: Box) -> Column:
    """Share of the cell's area lying under the box; 0 for an empty cell."""
    return F.when(cell.area <= 0, F.lit(0.0)).otherwise(
        intersection_area(cell, b) / F.nullif(cell.area, F.lit(0)))


def intersects(a: Box, b: Box) -> Column:
    return (a.x1 < b.x2) & (a.x2 > b.x1) & (a.y1 < b.y2) & (a.y2 > b.y1)


def center_in(a: Box, b: Box) -> Column:
    return a.cx.between(b.x1, b.x2) & a.cy.between(b.y1, b.y2)


def iou(a: Box, b: Box) -> Column:
    inter = intersection_area(a, b)
    return inter / (a.area + b.area - inter + F.lit(1e-9))


def hit(det: Box, gt: Box, mode: str = "center", thr: float = 0.3) -> Column:
    """mode: center | iou | either."""
    if mode == "center":
        return center_in(det, gt)
    if mode == "iou":
        return iou(det, gt) >= thr
    return (iou(det, gt) >= thr) | center_in(det, gt)


def clipped(b: Box, w: Column, h: Column) -> Box:
    zero = F.lit(0.0)
    return Box(F.greatest(b.x1, zero), F.greatest(b.y1, zero), F.least(b.x2, w), F.least(b.y2, h))


def scaled(b: Box, k: Column) -> Box:
    return Box(b.x1 * k, b.y1 * k, b.x2 * k, b.y2 * k)


def to_frame(b: Box, tile_x1: Column, tile_y1: Column, scale: Column) -> Box:
    return Box(tile_x1 + b.x1 / scale, tile_y1 + b.y1 / scale,
               tile_x1 + b.x2 / scale, tile_y1 + b.y2 / scale)


def tile_scale(w: Column, h: Column, upscale: float, max_side: int) -> Column:
    longest = F.greatest(w, h)
    return F.when(longest * upscale > max_side, max_side / longest).otherwise(F.lit(float(upscale)))


def yolo_to_xyxy(cx: Column, cy: Column, bw: Column, bh: Column, w: Column, h: Column) -> Box:
    return Box((cx - bw / 2) * w, (cy - bh / 2) * h, (cx + bw / 2) * w, (cy + bh / 2) * h)


def xyxy_to_yolo(b: Box, w: Column, h: Column) -> list[Column]:
    return [(b.cx / w).alias("cx"), (b.cy / h).alias("cy"),
            (b.width / w).alias("w"), (b.height / h).alias("h")]


def yolo_line(cls: Column, b: Box, w: Column, h: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls.cast("int"),
                           b.cx / w, b.cy / h, b.width / w, b.height / h)


def letterbox(w: Column, h: Column, side: int, max_scale: float = 3.0) -> list[Column]:
    """Scale and offsets that centre a w x h crop on a square canvas."""
    s = F.least(side / w, side / h, F.lit(max_scale))
    return [s.alias("scale"),
            F.floor((side - F.floor(w * s)) / 2).alias("off_x"),
            F.floor((side - F.floor(h * s)) / 2).alias("off_y")]


# --- cell lattices ----------------------------------------------------------------

def axis_positions(lo: Column, hi: Column, cell: Column, step: Column) -> Column:
    """Starts of cells covering [lo, hi): regular steps, plus one flush with the end."""
    last = hi - cell
    steps = F.sequence(lo, F.greatest(last, lo), step)
    flush = F.when(F.element_at(steps, -1) < last, F.concat(steps, F.array(last))).otherwise(steps)
    return F.when(hi - lo <= cell, F.array(lo)).otherwise(flush)


def cell_step(cell_px: Column, overlap: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(cell_px * (1 - overlap)).cast("int"))


def grid_signature(poly: Column, w: Column, h: Column, cell_px: Column, overlap: Column) -> Column:
    """Identity of a grid: any change of frame, cell size, overlap or polygon changes it."""
    vertices = F.transform(poly, lambda p: F.concat_ws(",", p[0].cast("string"), p[1].cast("string")))
    text = F.concat_ws(
        "|", F.concat(w.cast("string"), F.lit("x"), h.cast("string")),
        F.concat(F.lit("c"), cell_px.cast("string")),
        F.concat(F.lit("o"), F.format_string("%.2f", overlap.cast("double"))),
        F.array_join(vertices, "|"))
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def proposed_cell_px(h: Column) -> Column:
    """48 px at 1080 lines, rounded to 8, kept in 24..96."""
    return F.least(F.greatest(F.bround(48.0 * h / 1080 / 8) * 8, F.lit(24)), F.lit(96)).cast("int")
