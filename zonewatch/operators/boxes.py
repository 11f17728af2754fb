"""Joins and suppression over boxes, keyed by image and by a spatial bucket.

Boxes meet only inside a shared bucket of the plane, so an image with very many boxes is
spread over many join keys and far-apart pairs are never formed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewatch.functions import geometry as G
from zonewatch.session import has_hot_group, materialize

BUCKET = 256  # px; a few buckets per frame, most boxes touch one or two


def _bucket(v: Column, size: int) -> Column:
    return F.floor(v / size)


def in_buckets(df: DataFrame, b: G.Box, size: int = BUCKET) -> DataFrame:
    """One row per bucket the box touches."""
    return (df.withColumn("_bx", F.explode(F.sequence(_bucket(b.x1, size), _bucket(b.x2, size))))
            .withColumn("_by", F.explode(F.sequence(_bucket(b.y1, size), _bucket(b.y2, size)))))


def at_point(df: DataFrame, x: Column, y: Column, size: int = BUCKET) -> DataFrame:
    return df.withColumns({"_bx": _bucket(x, size), "_by": _bucket(y, size)})


def spatial_join(left: DataFrame, right: DataFrame, by: list[str],
                 predicate: Callable[[G.Box, G.Box], Column], lp: str = "", rp: str = "r_",
                 size: int = BUCKET) -> DataFrame:
    """Pairs of touching boxes of one key that satisfy the predicate, each pair once.

    A pair is reported from the bucket of its intersection's lower corner only.
    """
    a, b = G.box(lp), G.box(rp)
    at_corner = ((F.col("_bx") == _bucket(F.greatest(a.x1, b.x1), size))
                 & (F.col("_by") == _bucket(F.greatest(a.y1, b.y1), size)))
    pairs = in_buckets(left, a, size).join(in_buckets(right, b, size), [*by, "_bx", "_by"])
    return pairs.filter(at_corner & predicate(a, b)).drop("_bx", "_by")


def touched(left: DataFrame, right: DataFrame, by: list[str], ids: list[str],
            predicate: Callable[[G.Box, G.Box], Column], lp: str = "", rp: str = "r_",
            size: int = BUCKET) -> DataFrame:
    """Left rows for which some right box of the same key satisfies the predicate."""
    a, b = G.box(lp), G.box(rp)
    lk, rk = in_buckets(left, a, size).alias("l"), in_buckets(right, b, size).alias("r")
    keys = [*by, "_bx", "_by"]
    cond = predicate(a, b)
    for k in keys:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    found = lk.join(rk, cond, "left_semi").drop("_bx", "_by")
    return found.dropDuplicates([*by, *ids])


def with_flag(df: DataFrame, subset: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Mark the rows of df whose keys occur in subset (at most once there)."""
    marks = subset.select(*keys).withColumn(name, F.lit(True))
    return df.join(marks, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def iou_pairs(boxes: DataFrame, by: list[str], ids: list[str], thr: float) -> DataFrame:
    """Pairs (smaller id first) of one key overlapping with IoU above thr."""
    left = boxes.select(*by, *[F.col(c).alias(f"a_{c}") for c in ids],
                        *G.box().named("l_"))
    right = boxes.select(*by, *[F.col(c).alias(f"b_{c}") for c in ids], *G.box().named("r_"))
    first = F.struct(*[f"a_{c}" for c in ids]) < F.struct(*[f"b_{c}" for c in ids])
    return (spatial_join(left, right, by, lambda a, b: G.intersects(a, b) & first
                         & (G.iou(a, b) > thr), "l_", "r_")
            .withColumn("iou", G.iou(G.box("l_"), G.box("r_"))))


GREEDY_BOXES = 50_000  # boxes of one image that a single task may order


SMALL = 48  # boxes of one image up to which plain loops are faster than array steps


def _keep(b: list[tuple], iou_thr: float) -> list[int]:
    """Positions kept of boxes (x1, y1, x2, y2) in order of rank."""
    kept: list[int] = []
    for i, (x1, y1, x2, y2) in enumerate(b):
        area = (x2 - x1) * (y2 - y1)
        for k in kept:
            u1, v1, u2, v2 = b[k]
            both = max(min(x2, u2) - max(x1, u1), 0.0) * max(min(y2, v2) - max(y1, v1), 0.0)
            if both / (area + (u2 - u1) * (v2 - v1) - both + 1e-9) > iou_thr:
                break
        else:
            kept.append(i)
    return kept


def _keep_many(c: np.ndarray, iou_thr: float) -> list[int]:
    x1, y1, x2, y2 = c.T
    area, order, kept = (x2 - x1) * (y2 - y1), np.arange(len(c)), []
    while len(order):
        i, rest = order[0], order[1:]
        kept.append(int(i))
        w = np.minimum(x2[i], x2[rest]) - np.maximum(x1[i], x1[rest])
        h = np.minimum(y2[i], y2[rest]) - np.maximum(y1[i], y1[rest])
        both = np.maximum(w, 0.0) * np.maximum(h, 0.0)
        order = rest[both / (area[i] + area[rest] - both + 1e-9) <= iou_thr]
    return kept


def _image_starts(rows: pa.Table, by: list[str]) -> np.ndarray:
    change = np.zeros(rows.num_rows, dtype=bool)
    change[:1] = True
    for k in by:
        codes = rows.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def _suppress(rows: pa.Table, starts: np.ndarray, iou_thr: float) -> pa.Table:
    """Rows kept of whole images, sorted by image and rank."""
    c = np.stack([rows.column(x).to_numpy().astype(np.float64) for x in ("x1", "y1", "x2", "y2")], axis=1)
    kept: list[int] = []
    for a, b in zip(starts, [*starts[1:], rows.num_rows]):
        part = c[a:b]
        kept += [int(a) + i for i in (_keep(part.tolist(), iou_thr) if b - a <= SMALL else _keep_many(part, iou_thr))] if b - a > 1 else [int(a)]
    return rows.take(pa.array(kept, pa.int64()))


def nms(boxes: DataFrame, by: list[str], iou_thr: float = 0.5, score: str = "score") -> DataFrame:
    """Greedy non-maximum suppression.

    A box is dropped when a kept box of higher rank overlaps it. Rank: score, then the corners; of boxes
    with the same corners and score the one with the least other columns counts. A task goes through its
    images one by one; if some image has more than `GREEDY_BOXES` boxes, all go by rounds over the overlapping
    pairs: in each round the boxes nothing outranks are kept and those under them dropped.
    """
    corner = ["x1", "y1", "x2", "y2"]
    columns, rest = boxes.columns, [c for c in boxes.columns if c not in (*by, *corner, score)]
    if rest:
        boxes = boxes.groupBy(*by, *corner, score).agg(F.min(F.struct(*rest)).alias("_rest")).select(*by, *corner, score, "_rest.*")
    else:
        boxes = boxes.distinct()
    boxes = materialize(boxes.select(*columns))
    if not has_hot_group(boxes, by, GREEDY_BOXES):
        def run(batches):
            held = None  # the image that may go on in the next batch
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
                starts = _image_starts(rows, by)
                if len(starts):
                    done = int(starts[-1])
                    yield from _suppress(rows.slice(0, done), starts[:-1], iou_thr).to_batches()
                    held = rows.slice(done)
            if held is not None and held.num_rows:
                yield from _suppress(held, np.array([0]), iou_thr).to_batches()

        ranked = boxes.repartition(*by).sortWithinPartitions(*by, F.desc(score), *corner)
        return ranked.mapInArrow(run, boxes.schema)
    rank = F.struct((-F.col(score)).alias("s"), *corner)
    ranked = boxes.select(*by, rank.alias("id"), *corner)
    left = ranked.select(*by, F.col("id").alias("hi"), *G.box().named("l_"))
    right = ranked.select(*by, F.col("id").alias("lo"), *G.box().named("r_"))
    edges = materialize(
        spatial_join(left, right, by, lambda a, b: G.intersects(a, b)
                     & (F.col("hi") < F.col("lo")) & (G.iou(a, b) > iou_thr), "l_", "r_")
        .select(*by, "hi", "lo"))
    gone = None
    while edges.limit(1).count():
        ruled = edges.select(*by, F.col("lo").alias("hi")).distinct()
        free = edges.join(ruled, [*by, "hi"], "left_anti")
        out = materialize(free.select(*by, F.col("lo").alias("id")).distinct())
        gone = out if gone is None else gone.unionByName(out)
        edges = materialize(
            edges.join(out.withColumnRenamed("id", "hi"), [*by, "hi"], "left_anti")
            .join(out.withColumnRenamed("id", "lo"), [*by, "lo"], "left_anti"))
    if gone is None:
        return boxes
    return (boxes.withColumn("id", rank).join(gone, [*by, "id"], "left_anti").drop("id"))


# --- ground truth against detections ------------------------------------------------

def matched_gt(gt: DataFrame, det: DataFrame, by: list[str], ids: list[str],
               mode: str = "center", iou_thr: float = 0.3) -> DataFrame:
    """Ground-truth boxes hit by at least one detection of the same image."""
    det = det.select(*by, *G.box().named("r_"))
    if mode == "center":
        # a centre lies in exactly one bucket, so only the truth side is spread
        r = G.box("r_")
        points = at_point(det, r.cx, r.cy).alias("d")
        truth = in_buckets(gt, G.box()).alias("g")
        cond = G.center_in(r, G.box())
        for k in [*by, "_bx", "_by"]:
            cond = cond & (F.col(f"g.{k}") == F.col(f"d.{k}"))
        found = truth.join(points, cond, "left_semi").drop("_bx", "_by")
        return found.dropDuplicates([*by, *ids])
    return touched(gt, det, by, ids, lambda g, d: G.hit(d, g, mode, iou_thr))


def matched_by(gt: DataFrame, det: DataFrame, by: list[str], ids: list[str], who: list[str]) -> DataFrame:
    """(by.., who.., ids..): ground-truth boxes that hold the centre of a detection of each `who` (models, runs)."""
    r = G.box("r_")
    points = at_point(det.select(*by, *who, *G.box().named("r_")), r.cx, r.cy)
    met = in_buckets(gt, G.box()).join(points, [*by, "_bx", "_by"]).filter(G.center_in(r, G.box()))
    return met.select(*by, *who, *ids).distinct()


def match_gt(gt: DataFrame, det: DataFrame, by: list[str], ids: list[str],
             mode: str = "center", iou_thr: float = 0.3, name: str = "hit") -> DataFrame:
    return with_flag(gt, matched_gt(gt, det, by, ids, mode, iou_thr), [*by, *ids], name)


def extra_boxes(gt: DataFrame, det: DataFrame, by: list[str], mode: str,
                ids: list[str] | None = None) -> DataFrame:
    """Number of detections beyond the truth, by one of four definitions.

    per_frame  sum over images of max(0, detections - truths)
    total      max(0, all detections - all truths)
    off_target detections whose centre lies in no truth box
    unmatched  detections that are not the first match of any truth box
    """
    if mode in ("per_frame", "total"):
        n = (det.groupBy(*by).agg(F.count(F.lit(1)).alias("d"), F.lit(0).cast("bigint").alias("g"))
             .unionByName(gt.groupBy(*by).agg(F.lit(0).cast("bigint").alias("d"),
                                              F.count(F.lit(1)).alias("g")))
             .groupBy(*by).agg(F.sum("d").alias("d"), F.sum("g").alias("g")))
        if mode == "total":
            return n.agg(F.greatest(F.lit(0), F.sum("d") - F.sum("g")).alias("extra"))
        return n.agg(F.sum(F.greatest(F.lit(0), F.col("d") - F.col("g"))).alias("extra"))
    if mode == "off_target":
        d = at_point(det, G.box().cx, G.box().cy).alias("d")
        g = in_buckets(gt.select(*by, *G.box().named("r_")), G.box("r_")).alias("g")
        cond = G.center_in(G.box(), G.box("r_"))
        for k in [*by, "_bx", "_by"]:
            cond = cond & (F.col(f"g.{k}") == F.col(f"d.{k}"))
        return d.join(g, cond, "left_anti").agg(F.count(F.lit(1)).alias("extra"))
    if mode != "unmatched":
        raise ValueError(f"unknown mode: {mode}")
    ids = ids or ["x1", "y1", "x2", "y2"]
    left = gt.select(*by, F.struct(*ids).alias("g_id"), *G.box().named("l_"))
    right = det.select(*by, F.struct((-F.col("score")).alias("s"), *ids).alias("d_id"),
                       *G.box().named("r_"))
    firsts = (spatial_join(left, right, by, lambda g, d: G.hit(d, g, "either"), "l_", "r_")
              .groupBy(*by, "g_id").agg(F.min("d_id").alias("d_id"))
              .select(*by, "d_id").distinct())
    return (det.select(*by, F.struct((-F.col("score")).alias("s"), *ids).alias("d_id"))
            .join(firsts, [*by, "d_id"], "left_anti").agg(F.count(F.lit(1)).alias("extra")))
