"""Building and auditing labelled datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewatch.functions import geometry as G
from zonewatch.functions.keys import matches_any_word
from zonewatch.operators.ordered import indexed_values, join_back

REGION_FRAC = 0.40   # fixed: labels longer than this share of the image mark whole heaps
CLOSEUP_FRAC = 0.12  # fixed: a longer upper-median object marks a close-up


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    tagged = [df.withColumn("source", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def join_annotations(annotations: DataFrame, images: DataFrame, categories: DataFrame,
                     by: list[str] = ("source",)) -> DataFrame:
    """Annotations with their image and category name ('?' when it is unknown)."""
    by = list(by)
    cats = categories.select(*by, F.col("id").alias("category_id"), "name", "supercategory")
    return (annotations.join(images, [*by, "image_id"])
            .join(cats, [*by, "category_id"], "left")
            .withColumn("name", F.coalesce("name", F.lit("?"))))


def xywh_boxes(annotations: DataFrame) -> DataFrame:
    """bbox array (x, y, w, h) to corner columns."""
    b = F.col("bbox")
    return annotations.withColumns({"x1": b[0], "y1": b[1], "x2": b[0] + b[2], "y2": b[1] + b[3]}).drop("bbox")


def rescale_boxes(boxes: DataFrame) -> DataFrame:
    """To the size on disk: scale by disk_width / width; flags real rescales.

    Boxes under 2 px are dropped before clipping and after it.
    """
    k = F.col("disk_width") / F.col("width")
    out = boxes.withColumns({**dict(zip(("x1", "y1", "x2", "y2"), G.scaled(G.box(), k))),
                             "rescaled": F.abs(k - 1) > 0.01})
    return clip_boxes(out, F.col("disk_width"), F.col("disk_height"))


def clip_boxes(boxes: DataFrame, w: Column, h: Column, min_side: float = 2.0) -> DataFrame:
    b = G.box()
    big = (b.width >= min_side) & (b.height >= min_side)
    c = G.clipped(b, w, h)
    return boxes.filter(big).withColumns(dict(zip(("x1", "y1", "x2", "y2"), c))).filter(big)


def fit_max_side(boxes: DataFrame, max_side: int = 1280) -> DataFrame:
    s = F.least(F.lit(1.0), max_side / F.greatest("width", "height"))
    return boxes.withColumns({**dict(zip(("x1", "y1", "x2", "y2"), G.scaled(G.box(), s))), "shrink": s})


def _side() -> Column:
    b = G.box()
    return F.greatest(b.width, b.height)


def drop_region_labels(boxes: DataFrame, frac: float = REGION_FRAC) -> DataFrame:
    """Drop labels that cover whole heaps; images left without labels fall out."""
    return boxes.filter(_side() <= frac * F.greatest("width", "height"))


def route_closeup(boxes: DataFrame, image: list[str], frac: float = CLOSEUP_FRAC) -> DataFrame:
    """Per image: 'whole' when its upper-median object is large, else 'tile'."""
    sides = boxes.withColumn("side", _side())
    mid = indexed_values(sides, image, "side", {"median_side": F.floor(F.col("n") / 2)})
    dims = boxes.groupBy(*image).agg(F.max(F.greatest("width", "height")).alias("longest"))
    return mid.join(dims, image).withColumn(
        "route", F.when(F.col("median_side") > frac * F.col("longest"), F.lit("whole")).otherwise(F.lit("tile")))


def filter_classes(annotations: DataFrame, words: list[str] | None = None,
                   names: list[str] | None = None) -> DataFrame:
    """Classes whose name or supercategory contains a word, or that are listed."""
    if names is not None:
        return annotations.filter(F.col("name").isin(names))
    return annotations.filter(matches_any_word(F.concat_ws(" ", "name", "supercategory"), words))


def filter_folders(files: DataFrame, keep: list[str], folder: str = "folder") -> DataFrame:
    return files.filter(F.col(folder).isin(keep))


def missing_files(images: DataFrame, listing: DataFrame, urls: list[str]) -> DataFrame:
    """Annotated images not on disk, with their first known address."""
    return (images.join(listing.select("file_name"), "file_name", "left_anti")
            .withColumn("url", F.coalesce(*urls)))


# --- audit --------------------------------------------------------------------------

def orphans(labels: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Labels without an image and images without a label."""
    lost = labels.join(images, key, "left_anti").select(key, F.lit("label_without_image").alias("issue"))
    bare = images.join(labels, key, "left_anti").select(key, F.lit("image_without_label").alias("issue"))
    return lost.unionByName(bare)


def label_integrity(lines: DataFrame, by: list[str]) -> DataFrame:
    """lines(.., n_fields, cx, cy, w, h): malformed and out-of-frame labels."""
    degenerate = (F.col("n_fields") != 5) | (F.col("w") <= 0) | (F.col("h") <= 0)
    edges = [F.col("cx") - F.col("w") / 2, F.col("cy") - F.col("h") / 2,
             F.col("cx") + F.col("w") / 2, F.col("cy") + F.col("h") / 2]
    outside = F.lit(False)
    for e in edges:
        outside = outside | (e < -0.001) | (e > 1.001)
    return lines.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_labels"), F.count_if(degenerate).alias("n_degenerate"),
        F.count_if(~degenerate & outside).alias("n_outside"))


def source_balance(items: DataFrame, source: str = "source", limit: float = 0.5) -> DataFrame:
    """Share of each source; one above the limit dominates."""
    per = items.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("_total"))  # one row
    share = F.col("n") / F.col("_total")
    return (per.crossJoin(F.broadcast(total)).withColumn("share", share)
            .withColumn("dominates", share > limit).drop("_total"))


def split_leakage(items: DataFrame, source: str = "source", clip: str = "clip",
                  split: str = "split") -> DataFrame:
    """Clips with items on both sides of the split, per source."""
    sides = items.groupBy(source, clip).agg(F.min(split).alias("_lo"), F.max(split).alias("_hi"))
    return sides.groupBy(source).agg(F.count(F.lit(1)).alias("n_clips"),
                                     F.count_if(F.col("_lo") != F.col("_hi")).alias("n_leaked"))


def size_stats(boxes: DataFrame, by: list[str], side: str, scale: float = 640.0) -> DataFrame:
    """Quartiles by sorted position and the share of objects under 12 px."""
    n = F.col("n")
    q = indexed_values(boxes, by, side, {"p25": F.floor(n / 4), "p50": F.floor(n / 2), "p75": F.floor(3 * n / 4)})
    tiny = boxes.groupBy(*by).agg(F.avg((F.col(side) * scale < 12).cast("int")).alias("tiny_share"))
    return join_back(q, tiny, by)


def region_label_share(boxes: DataFrame, by: list[str], frac: float = REGION_FRAC) -> DataFrame:
    big = _side() / F.greatest("width", "height") >= frac
    return boxes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_labels"), F.avg(big.cast("int")).alias("region_share"))


def class_counts(annotations: DataFrame, name: str, top: int = 10) -> DataFrame:
    return (annotations.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), name).limit(top))


def in_band_share(boxes: DataFrame, by: list[str], lo: float = 0.06, hi: float = 0.40) -> DataFrame:
    """Object size after fitting to 1280 and tiling to 240: median and share in band."""
    frac = _side() * 1280 / F.greatest("width", "height") / 240
    sized = boxes.withColumn("frac", frac)
    mid = indexed_values(sized, by, "frac", {"median_frac": F.floor(F.col("n") / 2)})
    share = sized.groupBy(*by).agg(F.avg(F.col("frac").between(lo, hi).cast("int")).alias("in_band"))
    return join_back(mid, share, by)


def tile_splits(tiles: DataFrame, images: DataFrame, by=("source", "image_id")) -> DataFrame:
    """Tiles with the clip of their image; tiles of unknown images fall out."""
    return tiles.join(images.select(*by, "file_name"), list(by))


def audit_passes(integrity: DataFrame, leakage: DataFrame, orphan: DataFrame) -> DataFrame:
    """One row: the counts that make the audit fail, and its verdict."""
    a = integrity.agg(F.coalesce(F.sum("n_degenerate"), F.lit(0)).alias("n_degenerate"))
    b = leakage.agg(F.coalesce(F.sum("n_leaked"), F.lit(0)).alias("n_leaked"))
    c = orphan.agg(F.count_if(F.col("issue") == "label_without_image").alias("n_orphans"))
    bad = F.col("n_degenerate") + F.col("n_leaked") + F.col("n_orphans")
    one = lambda df: F.broadcast(df)  # each side is a single aggregated row
    return a.crossJoin(one(b)).crossJoin(one(c)).withColumn("passes", bad == 0)
