"""Readers with fixed schemas for the files around the system."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewatch import schemas
from zonewatch.operators.ordered import arrange
from zonewatch.sources.documents import read_elements

IMAGE_GLOB = "*.{jpg,jpeg,png,bmp,webp,JPG,JPEG,PNG,BMP,WEBP}"  # fixed: accepted file types


def _file(path: Column | None = None) -> Column:
    return F.col("_metadata.file_path") if path is None else path


def read_frames(spark: SparkSession, path: str, camera_id: str, interval_s: float,
                decode: Callable[[bytes], tuple[int, int, int, bytes] | None] | None = None,
                keep_unreadable: bool = False) -> DataFrame:
    """Decoded images of a folder in name order, one interval apart.

    Every accepted file counts for the time, also one that cannot be decoded; those are left out, or with
    `keep_unreadable` returned with null pixels. Java reads no .webp: with such a file a read fails unless
    `decode` is passed, a function from file contents to (width, height, channels, BGR bytes) or None.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).load(path)
    names = (arrange(listing.select(F.lit(camera_id).alias("camera_id"), F.col("path").alias("origin")), ["camera_id"], ["origin"])
             .rank("_rn").done())
    if decode is None:
        img = (spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", IMAGE_GLOB).load(path)
               .select(F.col("image.origin").alias("origin"), F.col("image.width").alias("width"), F.col("image.height").alias("height"),
                       F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data")).filter("width > 0"))
    else:
        def run(batches):
            for batch in batches:
                got = [decode(c) or (None,) * 4 for c in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), *[pa.array([g[i] for g in got], t) for i, t in enumerate(
                    (pa.int32(), pa.int32(), pa.int32(), pa.binary()))]], names=["origin", "width", "height", "channels", "data"])
        img = listing.select("path", "content").mapInArrow(run, "origin string, width int, height int, channels int, data binary").filter("width IS NOT NULL")
    # the two readers write a path differently (file:///x, file:/x)
    plain = lambda c: F.regexp_replace(c, "^(file|hdfs):/+", "/")
    img = img.select(plain("origin").alias("_file"), "width", "height", "channels", "data")
    file = plain("origin")
    if decode is None:
        file = F.when(F.lower("origin").endswith(".webp"), F.raise_error(F.concat(F.lit("pass decode to read "), "origin"))).otherwise(file)
    return (names.withColumn("_file", file).join(img, "_file", "left" if keep_unreadable else "inner")
            .select("camera_id", (F.col("_rn") - 1).alias("scan_no"),
                    F.timestamp_micros(((F.col("_rn") - 1) * F.lit(interval_s * 1_000_000)).cast("bigint")).alias("ts"),
                    "width", "height", "channels", "data"))


def stream_frames(spark: SparkSession, path: str) -> DataFrame:
    """New image files as they arrive (undecoded)."""
    return (spark.readStream.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).load(path)
            .select("path", F.col("modificationTime").alias("ts"), F.col("content").alias("data")))


def read_zones(spark: SparkSession, path: str, frame_w: int = 1920, frame_h: int = 1080) -> DataFrame:
    """Zone files ({"points": [[x, y], ..]}); the file name is the zone."""
    df = spark.read.schema(schemas.ZONE_FILE).option("multiLine", True).json(path)
    ok = F.coalesce(F.size("points") >= 3, F.lit(False))
    points = F.when(ok, F.col("points")).otherwise(F.raise_error(F.lit("a zone needs at least 3 points")))
    name = F.regexp_extract(_file(), r"([^/]+)\.json$", 1)
    return df.select(name.alias("camera_id"), F.lit("z0").alias("zone_id"), points.alias("points"),
                     F.lit(frame_w).alias("frame_w"), F.lit(frame_h).alias("frame_h"))


def read_zone_lines(spark: SparkSession, path: str) -> DataFrame:
    """Zones as `write_zones` writes them: a line each, with their keys."""
    df = spark.read.schema(schemas.ZONES).json(path)
    ok = F.coalesce(F.size("points") >= 3, F.lit(False))
    return df.withColumn("points", F.when(ok, F.col("points")).otherwise(F.raise_error(F.lit("a zone needs at least 3 points"))))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth files ({"intervals": [[a, b], ..]}, seconds); the file name is the camera."""
    df = spark.read.schema(schemas.TRUTH_FILE).option("multiLine", True).json(path)
    name = F.regexp_extract(_file(), r"([^/]+)\.json$", 1)
    return (df.select(name.alias("camera_id"), F.posexplode("intervals").alias("event_id", "i"))
            .select("camera_id", F.col("event_id").cast("bigint").alias("event_id"),
                    F.col("i")[0].alias("a"), F.col("i")[1].alias("b")))


def read_coco(spark: SparkSession, path: str, source: str, split: bool = True, glob: str = "*") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of annotation documents.

    Documents are read in byte ranges (`documents.read_elements`). With `split` off each is one value of one task,
    which does for many small documents.
    """
    src = F.lit(source).alias("source")
    if split:
        found = read_elements(spark, path, glob)
        # a row of its own per element: what is asked of the fields later does not parse the element once more
        part = lambda key: found.filter(F.col("key") == key).select(F.explode(F.array(F.from_json("element", schemas.COCO_PARTS[key]))).alias("x"))
    else:
        doc = spark.read.schema(schemas.COCO_FILE).option("multiLine", True).json(path)
        part = lambda key: doc.select(F.explode(key).alias("x"))
    images = part("images").select(
        src, F.col("x.id").alias("image_id"), "x.file_name", "x.width", "x.height",
        F.coalesce("x.flickr_640_url", "x.flickr_url", "x.coco_url").alias("url"))
    annotations = part("annotations").select(src, "x.image_id", "x.category_id", "x.bbox")
    categories = part("categories").select(src, "x.id", "x.name", "x.supercategory")
    return images, annotations, categories


def yolo_lines(lines: DataFrame, keep: list[int] | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """text lines (value, stem, line_no) -> labels; short or unreadable lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    num = [parts[i].try_cast("double") for i in range(1, 5)]
    out = (lines.filter(F.size(parts) >= 5)
           .select(*also, "stem", "line_no", F.size(parts).alias("n_fields"), parts[0].try_cast("double").cast("int").alias("cls"),
                   *[c.alias(n) for c, n in zip(num, ("cx", "cy", "w", "h"))])
           .filter("cls is not null and cx is not null and cy is not null and w is not null and h is not null"))
    return out.filter(F.col("cls").isin(keep)) if keep else out


def read_yolo(spark: SparkSession, path: str, source: str, keep: list[int] | None = None) -> DataFrame:
    """Label files of one source; an image without any box yields no row."""
    stem = F.regexp_extract(_file(), r"([^/]+)\.txt$", 1)
    raw = (spark.read.option("wholetext", True).text(path).select(stem.alias("stem"), F.split("value", "\n").alias("v"))
           .select("stem", F.posexplode("v").alias("line_no", "value")))
    return yolo_lines(raw, keep).withColumn("source", F.lit(source))


def read_yolo_lines(spark: SparkSession, path: str, source: str, keep: list[int] | None = None) -> DataFrame:
    """Label lines that start with their tile and a tab (`write_yolo_text`), with their split."""
    v = F.split("value", "\t", 2)
    lines = spark.read.text(path).select("split", v[0].alias("stem"), F.lit(0).alias("line_no"), v[1].alias("value"))
    return yolo_lines(lines, keep, ("split",)).drop("line_no").withColumn("source", F.lit(source))


def read_listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder, with their folder name; contents are not read."""
    f = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
         .load(path).select("path"))
    return f.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
                    F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"))


def read_region_csv(spark: SparkSession, csv: str, listing: DataFrame) -> DataFrame:
    """Boxes from a CSV (filename, x1..y2); rows without whole numbers are dropped and a
    name found in several folders stands for the lowest path."""
    raw = spark.read.option("header", True).schema("filename string, x1 string, y1 string, x2 string, y2 string").csv(csv)
    nums = [F.trim(c).try_cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]
    boxes = raw.select(F.col("filename").alias("file_name"), *nums).dropna()
    paths = listing.groupBy("file_name").agg(F.min("path").alias("path"))
    return boxes.join(paths, "file_name")


def read_scan_log(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Scan logs with their file as segment; quoted cell lists may hold commas.

    Older segments are named by their time; the running one has no time and comes last.
    """
    df = (spark.read.schema(schemas.SCAN_LOG).option("header", True).option("quote", '"').csv(paths)
          .withColumn("segment", F.regexp_extract(_file(), r"([^/]+)\.csv$", 1)))
    stamp = F.regexp_extract("segment", r"_(\d[\d_-]*)$", 1)
    order = F.when(stamp == "", F.lit("~")).otherwise(stamp)
    flags = {c: F.col(c) == 1 for c in ("dirty", "alert", "escalated", "global_change", "ref_reset", "verify_failed")}
    return df.withColumns({**flags, "segment_order": order, "cells": F.split("hot_cells", " ")})


def read_scans_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """Packed scans arriving as Parquet files."""
    return spark.readStream.schema(schemas.SCANS).option("maxFilesPerTrigger", max_files).parquet(path)

