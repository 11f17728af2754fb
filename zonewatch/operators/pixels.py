"""Pixels: masks and objects on pixel tables, kernels on whole frames.

A pixel table has one row per pixel (keys.., row, col, gray); masks are the rows that are
set. Masks grow and shrink by exploding neighbour offsets, so a large frame is spread over
tasks. Only block means and spectra, which need the frame as an array, run in numpy on
Arrow batches, one frame at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewatch.operators import gates
from zonewatch.operators.clusters import components
from zonewatch.operators.ordered import arrange
from zonewatch.operators.zone_scan import KEY
from zonewatch.session import broadcast_if_small, dealt_by_some_keys, materialize, release

SIDE = 8        # fixed: a descriptor is 8 x 8
THUMB = 256     # fixed: side of a thumbnail
HASHED_PIXELS = 500_000  # pixels of backgrounds that a task may hold at once


# --- pixel tables -------------------------------------------------------------------

def frame_rank(pixels: DataFrame, by: list[str], frame: str) -> DataFrame:
    """0-based number of each frame of a sequence, and how many there are."""
    frames = pixels.select(*by, frame).distinct()
    n = frames.groupBy(*by).agg(F.count(F.lit(1)).alias("n_frames"))
    return (arrange(frames, by, [frame]).rank("_rn").done().join(n, by)
            .withColumn("frame_no", F.col("_rn") - 1).drop("_rn"))


def median_background(pixels: DataFrame, by: list[str], frame: str, warm: int = 20,
                      frames: DataFrame | None = None) -> DataFrame:
    """Median of each pixel over the first `warm` frames, cut to whole gray values. `frames`: their `frame_rank`."""
    frames = frame_rank(pixels, by, frame) if frames is None else frames
    early = frames.filter(F.col("frame_no") < warm).select(*by, frame)
    place = Window.partitionBy(*by, "row", "col")
    ranked = (pixels.join(early.hint("shuffle_hash"), [*by, frame]).filter(F.col("gray").isNotNull())
              .select(*by, "row", "col", "gray", F.row_number().over(place.orderBy("gray")).alias("_rn"))
              .withColumn("_n", F.count(F.lit(1)).over(place)))
    middle = F.col("_rn").between(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1)
    return ranked.filter(middle).groupBy(*by, "row", "col").agg(F.floor(F.avg("gray")).cast("int").alias("ref"))


def diff_mask(pixels: DataFrame, background: DataFrame, by: list[str], frame: str,
              thr: float = 35.0, hashed: bool = False) -> DataFrame:
    """Pixels that differ from the background after removing each picture's mean.

    `hashed`: the backgrounds that meet in one task are known to fit into its memory, so nothing is sorted for them.
    """
    # one row per picture: a task holds those of its pixels, which need no sorting by picture then
    mean = pixels.groupBy(*by, frame).agg(F.avg("gray").alias("_m")).hint("shuffle_hash")
    ref_mean = background.groupBy(*by).agg(F.avg("ref").alias("_rm")).hint("shuffle_hash")
    d = (pixels.join(background.hint("shuffle_hash" if hashed else "merge"), [*by, "row", "col"]).join(mean, [*by, frame]).join(ref_mean, by)
         .filter(F.abs((F.col("gray") - F.col("_m")) - (F.col("ref") - F.col("_rm"))) > thr))
    return d.select(*by, frame, "row", "col")


def _along(mask: DataFrame, keys: list[str], axis: str, r: int) -> DataFrame:
    """Each pixel at all places up to r from it along one axis. Square kernels are one pass per axis."""
    off = F.sequence(F.lit(-r), F.lit(r))
    return (mask.select(*keys, "row", "col").withColumn("_d", F.explode(off))
            .withColumn(axis, F.col(axis) + F.col("_d")).drop("_d"))


def dilate(mask: DataFrame, keys: list[str], size: int, width: int, height: int) -> DataFrame:
    for axis, n in (("row", height), ("col", width)):
        mask = _along(mask, keys, axis, size // 2).filter(F.col(axis).between(0, n - 1)).distinct()
    return mask


def erode(mask: DataFrame, keys: list[str], size: int, width: int, height: int) -> DataFrame:
    """Pixels whose whole neighbourhood, as far as it lies in the frame, is set."""
    r = size // 2
    mask = mask.select(*keys, "row", "col")
    for axis, n in (("row", height), ("col", width)):
        need = F.least(F.col(axis) + r, F.lit(n - 1)) - F.greatest(F.col(axis) - r, F.lit(0)) + 1
        counted = _along(mask, keys, axis, r).filter(F.col(axis).between(0, n - 1)).groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("_n"))
        mask = counted.filter(F.col("_n") == need).drop("_n")
    return mask


def opened(mask: DataFrame, keys: list[str], width: int, height: int, size: int = 3) -> DataFrame:
    return dilate(erode(mask, keys, size, width, height), keys, size, width, height)


def stay_mask(masks: DataFrame, frames: DataFrame, by: list[str], frame: str, frac: float = 0.9) -> DataFrame:
    """Pixels set in more than `frac` of the last max(5, n/5) frames."""
    tail_n = F.greatest(F.lit(5).cast("bigint"), F.floor(F.col("n_frames") / 5))
    tail = (frames.withColumn("_tail", F.least(tail_n, F.col("n_frames")))
            .filter(F.col("frame_no") >= F.col("n_frames") - F.col("_tail")).select(*by, frame, "_tail"))
    return (masks.join(tail, [*by, frame]).groupBy(*by, "row", "col")
            .agg(F.count(F.lit(1)).alias("_n"), F.max("_tail").alias("_t"))
            .filter(F.col("_n") > frac * F.col("_t")).select(*by, "row", "col"))


def component_boxes(mask: DataFrame, by: list[str]) -> DataFrame:
    """Area and bounds (right and lower edge exclusive) of each 8-connected component."""
    comp = components(mask, by, 1)
    return comp.groupBy(*by, "comp_row", "comp_col").agg(
        F.count(F.lit(1)).alias("area"), F.min("col").alias("x1"), F.min("row").alias("y1"),
        (F.max("col") + 1).alias("x2"), (F.max("row") + 1).alias("y2"))


def largest_component(mask: DataFrame, by: list[str], lo: int, hi: float) -> DataFrame:
    """The largest component with lo <= area <= hi; ties go to the lowest pixel."""
    fit = component_boxes(mask, by).filter(F.col("area").between(lo, hi))
    w = Window.partitionBy(*by).orderBy(F.desc("area"), "comp_row", "comp_col")
    return fit.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "comp_row", "comp_col")


def box_coverage(masks: DataFrame, frames: DataFrame, boxes: DataFrame, by: list[str], frame: str) -> DataFrame:
    """Share of the box that is set, for every frame (0 where nothing is)."""
    inside = (F.col("col") >= F.col("x1")) & (F.col("col") < F.col("x2")) & (F.col("row") >= F.col("y1")) & (F.col("row") < F.col("y2"))
    n = masks.join(boxes, by).filter(inside).groupBy(*by, frame).agg(F.count(F.lit(1)).alias("_n"))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return (frames.join(boxes, by).join(n, [*by, frame], "left")
            .select(*by, frame, (F.coalesce("_n", F.lit(0)) / area).alias("coverage")))


def find_events(pixels: DataFrame, by: list[str], frame: str, width: int, height: int, warm: int = 20,
                thr: float = 35.0, min_area: int = 120, max_frac: float = 0.15, hold: float = 0.35,
                fps: float | None = None, per_task: int | None = None) -> DataFrame:
    """Left objects: for every sequence the frame from which its largest lasting change stays.

    Sequences without one come out with NULLs. With `fps` the event's time in seconds comes along (event_s).
    Pixels that are dealt out by `by` already are not shuffled; `per_task` says how many sequences a task is then given.
    """
    keys = [*by, frame]
    with dealt_by_some_keys(pixels.sparkSession):  # pixels are read in here, and only what is set is written
        ranks = frame_rank(pixels, by, frame)
        raw = diff_mask(pixels, median_background(pixels, by, frame, warm, ranks), by, frame, thr,
                        hashed=per_task is not None and per_task * width * height <= HASHED_PIXELS)
        masks = materialize(dilate(opened(raw, keys, width, height), keys, 7, width, height))
        frames = materialize(ranks)
    boxes = materialize(largest_component(stay_mask(masks, frames, by, frame), by, min_area, max_frac * width * height))
    cover = materialize(box_coverage(masks, frames, boxes, by, frame))
    release(masks)
    kept = gates.persist_from(cover, F.col("coverage"), hold, by, [frame])
    start = kept.filter("persists").groupBy(*by).agg(F.min(frame).alias("event_frame"))
    out = frames.select(*by).distinct().join(boxes, by, "left").join(start, by, "left")
    return out if fps is None else out.withColumn("event_s", F.col("event_frame") / F.lit(float(fps)))


def color_count(pixels: DataFrame, by: list[str], predicate: Column, at_least: int = 60) -> DataFrame:
    n = F.count_if(predicate)
    return pixels.groupBy(*by).agg(n.alias("n_pixels"), (n >= at_least).alias("hit"))


def diff_objects(pixels: DataFrame, background: DataFrame, keys: list[str], by: list[str], width: int,
                 height: int, thr: int = 40, min_area: int = 90, min_side: int = 12,
                 left: float = 0.10, shrink: int = 6) -> DataFrame:
    """Objects by background subtraction: difference, opening, two dilations, components."""
    raw = (pixels.join(background, [*by, "row", "col"])
           .filter(F.abs(F.col("gray") - F.col("ref")) > thr).select(*keys, "row", "col"))
    # two 7 x 7 dilations are one of 13 x 13
    grown = dilate(opened(raw, keys, width, height), keys, 13, width, height)
    b = component_boxes(grown, keys)
    long_side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    ok = (F.col("area") >= min_area) & (long_side >= min_side) & (F.col("x1") >= left * width)
    return b.filter(ok).select(*keys, "area", (F.col("x1") + shrink).alias("x1"), (F.col("y1") + shrink).alias("y1"),
                               (F.col("x2") - shrink).alias("x2"), (F.col("y2") - shrink).alias("y2"))


# --- whole frames -------------------------------------------------------------------

def area_weights(n_in: int, n_out: int) -> np.ndarray:
    """Rows of averaging weights that shrink n_in samples to n_out by area."""
    edges = np.linspace(0, n_in, n_out + 1)
    i = np.arange(n_in)
    cover = np.minimum(edges[1:, None], i + 1) - np.maximum(edges[:-1, None], i)
    w = np.clip(cover, 0, None)
    return w / w.sum(axis=1, keepdims=True)


def gray_plane(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Gray values of a BGR (or gray) frame, rounded like 8-bit conversion does."""
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return px[:, :, 0]
    b, g, r = (px[:, :, i].astype(np.float64) for i in range(3))
    return np.rint(0.114 * b + 0.587 * g + 0.299 * r).astype(np.uint8)


def shrink(gray: np.ndarray, out_h: int, out_w: int) -> np.ndarray:
    small = area_weights(gray.shape[0], out_h) @ gray.astype(np.float64) @ area_weights(gray.shape[1], out_w).T
    return np.rint(small)


def describe(patch: np.ndarray) -> np.ndarray:
    d = shrink(patch, SIDE, SIDE)
    return (d - d.mean()).ravel().astype(np.float32)


def describe_frames(frames: DataFrame, cells: DataFrame,
                    make_scorer: Callable[[], Callable[[list[np.ndarray]], list[float]]] | None = None) -> DataFrame:
    """Frames and grid cells to one packed scan row per frame and zone.

    The grid travels as arrays (one row per zone) so that a frame is decoded once. `make_scorer` is called once per
    task, to load a model, say; what it returns gets the patches of a frame (height x width x channels, a patch per
    cell) and gives a score for each, which the classifier mode of the zone scan decides by (`score`).
    """
    grid = (cells.groupBy(*KEY, "sig").agg(
        F.sort_array(F.collect_list(F.struct("row", "col", "x1", "y1", "x2", "y2"))).alias("c"))
        .select(*KEY, "sig", *[F.col(f"c.{n}").alias(f"_{n}") for n in ("row", "col", "x1", "y1", "x2", "y2")]))
    schema = T.StructType([
        T.StructField("camera_id", frames.schema["camera_id"].dataType), T.StructField("zone_id", T.StringType()),
        T.StructField("sig", T.StringType()), T.StructField("scan_no", T.LongType()),
        T.StructField("ts", T.TimestampType()), T.StructField("t_s", T.DoubleType()),
        T.StructField("n_cells", T.IntegerType()), T.StructField("rows", T.ArrayType(T.IntegerType())),
        T.StructField("cols", T.ArrayType(T.IntegerType())), T.StructField("desc", T.ArrayType(T.FloatType())),
        *([T.StructField("score", T.ArrayType(T.DoubleType()))] if make_scorer else [])])

    def scored(score, f) -> list[float]:
        px = np.frombuffer(f["data"], np.uint8).reshape(f["height"], f["width"], f["channels"])
        patches = [px[y1:y2, x1:x2] for x1, y1, x2, y2 in zip(f["_x1"], f["_y1"], f["_x2"], f["_y2"])]
        got = [float(v) for v in score(patches)]
        if len(got) != len(patches):
            raise ValueError(f"the scorer gave {len(got)} scores for {len(patches)} patches")
        return got

    def run(batches):
        score = make_scorer() if make_scorer else None
        for pdf in batches:
            out = []
            for f in pdf.itertuples(index=False, name=None):
                f = dict(zip(pdf.columns, f))
                gray = gray_plane(f["data"], f["width"], f["height"], f["channels"])
                parts = [describe(gray[y1:y2, x1:x2])
                         for x1, y1, x2, y2 in zip(f["_x1"], f["_y1"], f["_x2"], f["_y2"])]
                out.append((f["camera_id"], f["zone_id"], f["sig"], f["scan_no"], f["ts"],
                            f["t_s"], len(parts), f["_row"], f["_col"], np.concatenate(parts),
                            *([scored(score, f)] if score else [])))
            yield pd.DataFrame(out, columns=schema.names)

    timed = frames.withColumn("t_s", F.unix_micros("ts") / 1_000_000.0)
    # frames are heavy: with a small grid table they are not shuffled
    return timed.join(broadcast_if_small(grid), "camera_id").mapInPandas(run, schema)


def thumbs(frames: DataFrame, size: int = THUMB) -> DataFrame:
    """Gray thumbnail of each frame as float32 bytes."""
    names = ["camera_id", "scan_no", "ts", "width", "height"]
    schema = T.StructType([frames.schema[c] for c in names] + [T.StructField("thumb", T.BinaryType())])

    def run(batches):
        for pdf in batches:
            out = pdf[names].copy()
            out["thumb"] = [shrink(gray_plane(d, w, h, c), size, size).astype(np.float32).tobytes()
                            for d, w, h, c in zip(pdf["data"], pdf["width"], pdf["height"], pdf["channels"])]
            yield out

    return frames.mapInPandas(run, schema)


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Translation between two pictures: peak of the normalised cross-power spectrum,
    refined by the centroid of its 5 x 5 surroundings."""
    cross = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    size = np.abs(cross)
    corr = np.fft.fftshift(np.fft.ifft2(np.divide(cross, size, out=np.zeros_like(cross), where=size > 1e-12)).real)
    py, px = np.unravel_index(int(np.argmax(corr)), corr.shape)
    y0, y1 = max(0, py - 2), min(corr.shape[0], py + 3)
    x0, x1 = max(0, px - 2), min(corr.shape[1], px + 3)
    win = corr[y0:y1, x0:x1]
    total = win.sum()
    if abs(total) < 1e-12:
        return 0.0, 0.0
    cy = (win.sum(axis=1) * np.arange(y0, y1)).sum() / total
    cx = (win.sum(axis=0) * np.arange(x0, x1)).sum() / total
    return float(cx - corr.shape[1] // 2), float(cy - corr.shape[0] // 2)


def _shift_between(df: DataFrame, first: str, second: str, keep: list[str]) -> DataFrame:
    schema = T.StructType([df.schema[c] for c in keep] + [
        T.StructField(n, T.DoubleType()) for n in ("dx", "dy", "shift_px")])

    def run(batches):
        for pdf in batches:
            out = pdf[keep].copy()
            moves = []
            for a, b, w, h in zip(pdf[first], pdf[second], pdf["width"], pdf["height"]):
                if a is None or len(a) != len(b):
                    moves.append((0.0, 0.0, 0.0))
                    continue
                n = int(round((len(b) // 4) ** 0.5))
                dx, dy = phase_shift(np.frombuffer(a, np.float32).reshape(n, n),
                                     np.frombuffer(b, np.float32).reshape(n, n))
                dx, dy = dx * w / n, dy * h / n  # each axis by its own scale
                moves.append((dx, dy, float(np.hypot(dx, dy))))
            out[["dx", "dy", "shift_px"]] = moves
            yield out

    return df.mapInPandas(run, schema)


def scene_shift(thumb: DataFrame, by: list[str], order: str) -> DataFrame:
    """Movement against the previous scan, in full-resolution pixels; 0 for the first."""
    prev = arrange(thumb, by, [order]).lag({"_prev": F.col("thumb")}).done()
    return _shift_between(prev, "_prev", "thumb", [*by, order])


def anchor_drift(thumb: DataFrame, anchors: DataFrame, by: list[str], order: str, thr: float) -> DataFrame:
    """Scans that have moved more than thr from the stored anchor of their camera."""
    both = thumb.join(anchors.select(*by, F.col("thumb").alias("_anchor")), by)
    return _shift_between(both, "_anchor", "thumb", [*by, order]).filter(F.col("shift_px") > thr)


def add_noise_and_blur(plan: DataFrame, ids: list[str]) -> DataFrame:
    """Apply an augmentation plan (blur_k, noise_sigma) to gray frames; noise is seeded by the row."""
    schema = T.StructType([plan.schema[c] for c in [*ids, "copy", "width", "height"]]
                          + [T.StructField("data", T.BinaryType())])

    def run(batches):
        for pdf in batches:
            out = pdf[[*ids, "copy", "width", "height"]].copy()
            made = []
            for i, r in enumerate(pdf.to_dict("records")):
                g = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"]).astype(np.float64)
                if r["blur_k"] == r["blur_k"] and r["blur_k"] is not None:
                    k = int(r["blur_k"])
                    pad = np.pad(g, k // 2, mode="reflect")
                    g = np.lib.stride_tricks.sliding_window_view(pad, (k, k)).mean(axis=(2, 3))
                if r["noise_sigma"] == r["noise_sigma"] and r["noise_sigma"] is not None:
                    seed = abs(hash(tuple(int(r[c]) for c in [*ids, "copy"])))
                    g = g + np.random.default_rng(seed).normal(0, r["noise_sigma"], g.shape)
                made.append(np.clip(np.rint(g), 0, 255).astype(np.uint8).tobytes())
            out["data"] = made
            yield out

    return plan.mapInPandas(run, schema)
