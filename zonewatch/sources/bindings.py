"""The driver's tables seen as the library's inputs (observations, boxes, logs, zones)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CHANGE_THR = 50.0      # an event at or above it counts as a changed cell
HOT_THR = 100.0        # an event at or above it counts as a hot cell
FRAME_W, FRAME_H = 640, 480


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table. Stored times carry no zone, so they are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> one observation of one cell of one zone."""
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("zone"), "user_id", "event_id",
        F.floor(u / 16).cast("int").alias("row"), (u % 16).cast("int").alias("col"),
        F.unix_micros("ts").alias("t_us"), "value", (F.col("value") >= CHANGE_THR).alias("changed"))


def daily_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot cells per zone and day, with pixel corners on a 32 px lattice."""
    o = observations(spark, sf_dir)
    cells = (o.filter(F.col("value") >= HOT_THR)
             .select("zone", F.floor(F.col("t_us") / 86_400_000_000).cast("int").alias("day"), "row", "col")
             .distinct())
    return cells.select("*", (F.col("col") * 32).alias("x1"), (F.col("row") * 32).alias("y1"),
                        (F.col("col") * 32 + 64).alias("x2"), (F.col("row") * 32 + 64).alias("y2"))


def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> a scan log: one row per zone and hour."""
    o = observations(spark, sf_dir)
    hour = F.floor(F.col("t_us") / 3_600_000_000)
    hot = F.col("value") >= HOT_THR
    cell = F.when(hot, F.concat_ws(",", "row", "col"))
    per = (o.withColumn("scan_no", hour).groupBy("zone", "scan_no").agg(
        F.count_if(hot).alias("n_hot"), F.count_if("changed").alias("n_changed"),
        F.count(F.lit(1)).alias("n_cells"), F.array_sort(F.collect_set(cell)).alias("_hot"),
        F.max("value").alias("_max"), F.sum("value").alias("_sum")))
    return per.select(
        "zone", "scan_no", (F.col("scan_no") * 3600).cast("double").alias("t_s"),
        (F.col("n_hot") >= 1).alias("dirty"), (F.col("n_hot") >= 2).alias("alert"), "n_hot",
        "n_changed", "n_cells", F.array_join("_hot", " ").alias("hot_cells"),
        F.greatest(F.col("n_changed") - 3, F.lit(0).cast("bigint")).alias("n_dropped"),
        (F.col("n_changed") - F.col("n_hot")).alias("n_verify_dropped"),
        F.col("n_hot").alias("n_verify_boxes"), (F.col("n_hot") % 2).alias("n_muted_hit"),
        (F.col("_max") / 100).alias("shift_px"), F.col("_sum").alias("ms"),
        F.least(F.lit(1.0), (F.col("scan_no") + 10) % 97 / 60.0).alias("mask_progress"))


IMAGE_ROWS = 200_000  # rows of boxes that a task is given


def image_parts(spark: SparkSession, sf_dir: str) -> int:
    """Into how many parts boxes are dealt out by image, so that a part does not grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), table(spark, sf_dir, "lineitem").count() // IMAGE_ROWS + 1)


def boxes(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """lineitem -> distinct scored boxes of an image (the order). With `parts` dealt out by image, before anything else:
    an order has few lines."""
    x1, y1 = (F.col("l_partkey") * 37) % 400, (F.col("l_suppkey") * 53) % 200
    w, h = F.col("l_quantity") * 4 + 8, F.bround(F.col("l_tax") * 1000) + 10
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
        (x1 + w).cast("double").alias("x2"), (y1 + h).cast("double").alias("y2"),
        F.bround(F.col("l_discount") * 10, 2).alias("score"),
        F.col("l_linestatus").alias("kind"), F.col("l_returnflag").alias("model"))
    return (rows.repartition(parts, "image") if parts else rows).distinct()


def truth_boxes(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    return boxes(spark, sf_dir, parts).filter("kind = 'F'").select("image", "x1", "y1", "x2", "y2").distinct()


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (boxes(spark, sf_dir).filter("kind = 'O'")
            .groupBy("image", "x1", "y1", "x2", "y2").agg(F.max("score").alias("score")))


def _zone_points(k: Column) -> Column:
    a, b = (k % 40) / 100.0, (k * 7 % 40) / 100.0
    return F.array(F.array(a, b), F.array(a + 0.40, b + 0.05), F.array(a + 0.45, b + 0.50),
                   F.array(a + 0.02, b + 0.45))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> one quadrilateral zone per camera."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("camera_id"), F.lit("z0").alias("zone_id"), _zone_points(k).alias("points"),
        F.lit(FRAME_W).alias("frame_w"), F.lit(FRAME_H).alias("frame_h"))


def zone_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> points in the frame of their supplier's camera."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("camera_id"), "l_orderkey", "l_linenumber",
        (F.col("l_partkey") * 37 % FRAME_W + 0.5).alias("px"),
        (F.col("l_orderkey") * 11 % FRAME_H + 0.5).alias("py"))


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> descriptor of one cell (the label) over time (the vector number)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("cell"), F.col("vec_id").alias("scan_no"), F.col("embedding").alias("desc"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> small gray frames: one per zone and day, one pixel per user."""
    o = observations(spark, sf_dir)
    return (o.withColumn("scan_no", F.floor(F.col("t_us") / 86_400_000_000).cast("int"))
            .groupBy("zone", "scan_no", "row", "col")
            .agg(F.least(F.lit(255), F.bround(F.sum("value"))).cast("int").alias("gray")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> annotated files of named sources, some of them video frames."""
    d = F.col("doc_id")
    src = F.regexp_replace("source", "src", "").cast("int")
    source = (F.when(src < 7, F.lit("RoLIDv")).when(src < 14, F.lit("UAVVaste")).otherwise(F.lit("TACO")))
    name = (F.when(src < 7, F.format_string("images/v%d_frame%d.jpg", (d / 10).cast("bigint"), d))
            .when(src < 14, F.format_string("images/BATCH_d%d_img_%d.jpg", (d / 8).cast("bigint"), d))
            .otherwise(F.format_string("batch_%d/%06d.jpg", src, d)))
    return table(spark, sf_dir, "documents").select(
        d.alias("image_id"), source.alias("source"), name.alias("file_name"), "lang", "n_chars")



def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> dense small pictures: a frame per zone and three days, hour x user lane."""
    o = observations(spark, sf_dir)
    return (o.groupBy("zone", F.floor(F.col("t_us") / 259_200_000_000).cast("int").alias("scan_no"),
                      (F.floor(F.col("t_us") / 3_600_000_000) % 24).cast("int").alias("row"),
                      (F.col("user_id") % 8).cast("int").alias("col"))
            .agg(F.least(F.lit(255), F.floor(F.max("value") * 2)).cast("int").alias("gray")))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> 8 x 8 gray frames, 30 s apart, of a camera per 125 vectors."""
    gray = F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(
        F.lit(255.0), 128 + 400 * v.cast("double"))).cast("int"))
    data = F.unhex(F.array_join(F.transform(gray, lambda g: F.lpad(F.hex(g), 2, "0")), ""))
    scan = F.col("vec_id") % 125
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 125).cast("string").alias("camera_id"), scan.alias("scan_no"),
        F.timestamp_seconds(scan * 30).alias("ts"), F.lit(8).alias("width"), F.lit(8).alias("height"),
        F.lit(1).alias("channels"), data.alias("data"))
