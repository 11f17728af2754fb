"""Where results go: logs, alerts, datasets, reports, live status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewatch.functions import geometry as G


def write_scan_log(stream: DataFrame, path: str, checkpoint: str, once: bool = False, name: str | None = None, **options):
    """Append every scan exactly once; the checkpoint takes the place of flushing each row."""
    w = (stream.writeStream.format("parquet").outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint))
    for k, v in options.items():
        w = w.option(k, v)
    w = w.queryName(name) if name else w
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")).start()


def hot_cells_text(rows: Column, cols: Column) -> Column:
    return F.array_join(F.zip_with(rows, cols, lambda r, c: F.concat_ws(",", r.cast("string"), c.cast("string"))), " ")


def alert_rows(scans: DataFrame, boxes: DataFrame, hulls: DataFrame, by: list[str]) -> DataFrame:
    """One row per detection of an alert scan, or its hull of hot cells when there is none.

    boxes(by.., x1..y2, conf); hulls(by.., x1..y2). The published score is always 1; the
    detector's confidence travels in `extra`.
    """
    alerts = scans.filter("alert")
    extra = lambda conf: F.struct(F.col("n_hot"), F.round(conf, 3).alias("det_conf"), F.col("n_fresh"),
                                  F.col("escalated"), (F.col("n_sweep_hot") > 0).alias("from_sweep"))
    seen = alerts.join(boxes, by).select(*by, *G.box().named(), extra(F.col("conf")).alias("extra"))
    bare = alerts.join(boxes.select(*by).distinct(), by, "left_anti").join(hulls, by)
    hull = bare.select(*by, *[c.cast("double") for c in G.box()], extra(F.lit(None).cast("double")).alias("extra"))
    corners = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    out = seen.unionByName(hull.toDF(*seen.columns))
    return out.select(*by, F.lit("trash").alias("label"), F.lit(1.0).alias("score"), corners.alias("bbox"), "extra")


def result_boxes(results: DataFrame, by: list[str]) -> DataFrame:
    """(by.., x1..y2, conf): the boxes that came through the zone scan, for `alert_rows`."""
    return (results.select(*by, F.explode("verify_boxes").alias("b"))
            .select(*by, *[F.col("b")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2", "conf"))]))


def result_hulls(results: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """(by.., x1..y2): hull of the hot cells of each scan; `cells` holds by.., row, col, x1..y2."""
    hot = results.select(*by, F.explode(F.arrays_zip(F.col("hot_rows").alias("row"), F.col("hot_cols").alias("col"))).alias("h"))
    hot = hot.select(*by, F.col("h.row").alias("row"), F.col("h.col").alias("col"))
    low, high = ("x1", "y1"), ("x2", "y2")
    return hot.join(cells.select(*by, "row", "col", *low, *high), [*by, "row", "col"]).groupBy(*by).agg(
        *[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high])


def hard_negatives(boxes: DataFrame, pad: int = 16, min_side: int = 24) -> DataFrame:
    """Crops around detections of a clean period: padded, clipped, not too small.

    boxes(.., x1..y2, conf, frame_w, frame_h)
    """
    b = G.box()
    whole = lambda v: v.cast("int")
    crop = {"cx1": F.greatest(F.lit(0), whole(b.x1) - pad), "cy1": F.greatest(F.lit(0), whole(b.y1) - pad),
            "cx2": F.least(F.col("frame_w"), whole(b.x2) + pad), "cy2": F.least(F.col("frame_h"), whole(b.y2) + pad)}
    small = F.least(F.col("cx2") - F.col("cx1"), F.col("cy2") - F.col("cy1"))
    return boxes.withColumns(crop).filter(small >= min_side).withColumn("conf", F.coalesce("conf", F.lit(0.0)))


def write_tiles(tiles: DataFrame, labels: DataFrame, path: str) -> None:
    """Tile and label tables, split and source as folders. Both need split, source, stem."""
    tiles.write.mode("overwrite").partitionBy("split", "source").parquet(f"{path}/tiles")
    labels.write.mode("overwrite").partitionBy("split", "source").parquet(f"{path}/labels")


def write_yolo_text(labels: DataFrame, path: str, side: Column) -> None:
    """Label lines, one folder per split; each line starts with its tile (stem) and a tab, so that
    millions of tiles do not become millions of folders. `read_yolo_lines` reads them."""
    line = G.yolo_line(F.coalesce(F.col("cls"), F.lit(0)), G.box(), side, side)
    (labels.select("split", F.concat_ws("\t", "stem", line).alias("value"))
     .write.mode("overwrite").partitionBy("split").text(path))


def write_class_names(spark, names: list[str], path: str) -> None:
    rows = [(f"{i}: {n}",) for i, n in enumerate(names)]
    spark.createDataFrame([("names:",), *rows], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A result table as JSON lines, or as the rows of a markdown table (each row one line)."""
    if fmt == "markdown":
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
        df.select(line.alias("value")).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").json(path)


def calibration_text(floor: DataFrame, by: list[str]) -> DataFrame:
    """Settings block per site from a noise-floor table."""
    block = F.format_string("change:\n  thr: %.1f\nstabilize:\n  min_px: %.1f", "thr", "min_px")
    return floor.filter("thr is not null").select(*by, block.alias("value"))


def write_zones(zones: DataFrame, path: str) -> None:
    """Normalised points rounded to four decimals."""
    pts = F.transform("points", lambda p: F.transform(p, lambda v: F.round(v, 4)))
    zones.withColumn("points", pts).write.mode("overwrite").json(path)


def upsert_status(path: str, by: list[str], order: str = "t_s"):
    """foreachBatch function keeping the latest row of each zone in a table.

    Two alternating folders hold the table, so a batch never overwrites what it reads.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in by]
        last = lambda df: df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("s")).select(*by, "s.*")
        new = last(batch)
        if epoch > 0:
            try:
                old = spark.read.schema(new.schema).parquet(f"{path}/v{(epoch - 1) % 2}")
                new = last(old.unionByName(new))
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        new.write.mode("overwrite").parquet(f"{path}/v{epoch % 2}")
    return write
