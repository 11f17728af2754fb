"""Detection quality: recall tables, size bands, operating points, configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewatch.functions import geometry as G
from zonewatch.functions.grading import band
from zonewatch.operators.boxes import at_point, in_buckets, touched, with_flag


def long_side() -> Column:
    b = G.box()
    return F.greatest(b.width, b.height)


def recall_by_group(matches: DataFrame, det: DataFrame, image: str, groups: list[str]) -> DataFrame:
    """`matches` and `det` carry the group columns; images without truth count through det."""
    d = det.groupBy(*groups, image).agg(F.count(F.lit(1)).alias("n_det"))
    m = matches.groupBy(*groups, image).agg(F.count(F.lit(1)).alias("n_gt"), F.count_if("hit").alias("n_hit"))
    z = F.lit(0).cast("bigint")
    per = m.join(d, [*groups, image], "full").select(
        *groups, image, *[F.coalesce(c, z).alias(c) for c in ("n_gt", "n_hit", "n_det")])
    return per.groupBy(*groups).agg(
        F.sum("n_hit").alias("n_hit"), F.sum("n_gt").alias("n_gt"), F.sum("n_det").alias("n_det"),
        F.count(F.lit(1)).alias("n_images"),
        F.sum(F.greatest(z, F.col("n_det") - F.col("n_gt"))).alias("n_extra"),
        (F.sum("n_hit") / F.nullif(F.sum("n_gt"), z)).alias("recall"))


def recall_by_band(matches: DataFrame, bands: list, dataset: str, size: Column | None = None) -> DataFrame:
    """Recall per size band for each dataset and over all ('(all)')."""
    b = matches.withColumn("band", band(long_side() if size is None else size, bands))
    out = b.rollup("band", dataset).agg(
        F.count(F.lit(1)).alias("n_gt"), F.count_if("hit").alias("n_hit"),
        F.grouping(dataset).alias("_all"), F.grouping("band").alias("_total"))
    return (out.filter("_total = 0").withColumn(dataset, F.when(F.col("_all") == 1, F.lit("(all)"))
                                                .otherwise(F.col(dataset).cast("string")))
            .withColumn("recall", F.col("n_hit") / F.col("n_gt")).drop("_all", "_total"))


def band_crosstab(boxes: DataFrame, source: str, value: Column, bands: list) -> DataFrame:
    """Share of each band per source in percent, and a total row."""
    b = boxes.withColumn("band", band(value, bands))
    n = F.count(F.lit(1))
    aggs = [(100.0 * F.count_if(F.col("band") == name) / n).alias(f"pct_{i}")
            for i, (name, _, _) in enumerate(bands)]
    return (b.rollup(source).agg(n.alias("n_boxes"), *aggs, F.grouping(source).alias("_all"))
            .withColumn(source, F.when(F.col("_all") == 1, F.lit("(all)")).otherwise(F.col(source)))
            .drop("_all"))


def image_recall(gt: DataFrame, matched: DataFrame, image: list[str], group: list[str]) -> DataFrame:
    """Share of images with truth in which at least one object was hit."""
    imgs = gt.select(*group, *image).distinct()
    hit = matched.select(*image).distinct().withColumn("hit", F.lit(True))
    return (imgs.join(hit, image, "left").groupBy(*group)
            .agg(F.count(F.lit(1)).alias("n_images"), F.count_if("hit").alias("n_hit"),
                 F.avg(F.coalesce(F.col("hit").cast("int"), F.lit(0))).alias("recall")))


def compare_configs(results: DataFrame) -> DataFrame:
    """results(config, frame, clean, n_gt, n_hit, n_box) -> one row per configuration."""
    dirty = ~F.col("clean")
    return results.groupBy("config").agg(
        F.sum(F.when(dirty, F.col("n_hit"))).alias("n_hit"), F.sum(F.when(dirty, F.col("n_gt"))).alias("n_gt"),
        F.sum(F.when(dirty, F.greatest(F.lit(0), F.col("n_box") - F.col("n_gt")))).alias("n_extra"),
        F.count_if("clean").alias("n_clean"),
        F.count_if(F.col("clean") & (F.col("n_box") > 0)).alias("n_clean_false"),
        (F.count_if(F.col("clean") & (F.col("n_box") > 0))
         / F.nullif(F.count_if("clean"), F.lit(0))).alias("clean_false_share"))


def _per_threshold(df: DataFrame, by: list[str], confs: list[float], value: str, name: str, share_of: Column | None = None) -> DataFrame:
    """(by.., conf, name): rows with at least each threshold, in one pass; as a share of `share_of` if given."""
    counts = df.groupBy(*by).agg(*[F.count_if(F.col(value) >= c).alias(f"_{i}") for i, c in enumerate(confs)], (share_of if share_of is not None else F.lit(None)).alias("_of"))
    at = lambda i: F.col(f"_{i}") / F.col("_of") if share_of is not None else F.col(f"_{i}")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("conf"), at(i).alias(name)) for i, c in enumerate(confs)]))
    return counts.select(*by, rows.alias("_r")).select(*by, "_r.conf", f"_r.{name}")


def threshold_curve(gt_hits: DataFrame, det: DataFrame, clean: DataFrame, confs: list[float],
                    by: list[str], n_gt: DataFrame | None = None) -> DataFrame:
    """Operating curve: per threshold the truths hit, boxes, extra boxes, boxes per clean frame.

    gt_hits: one row per truth with the best score among the detections that hit it, so a
    threshold needs no second match. With `n_gt` (by.., n_gt) truths that nothing hit may be
    left out of it (`hit_scores`).
    """
    z = F.lit(0).cast("bigint")
    if n_gt is None:
        n_gt = gt_hits.groupBy(*by).agg(F.count(F.lit(1)).alias("n_gt"))
    h = _per_threshold(gt_hits, by, confs, "best_score", "n_hit")
    d = _per_threshold(det, by, confs, "score", "n_box")
    c = _per_threshold(clean, by, confs, "score", "clean_boxes", F.count_distinct("frame"))
    rows = n_gt.withColumn("conf", F.explode(F.array(*[F.lit(c) for c in confs])))
    out = rows.join(h, [*by, "conf"], "left").join(d, [*by, "conf"], "left").join(c, [*by, "conf"], "left")
    return (out.withColumn("n_hit", F.coalesce("n_hit", z)).withColumn("n_box", F.coalesce("n_box", z))
            .withColumn("n_extra", F.greatest(z, F.col("n_box") - F.col("n_gt")))
            .withColumn("clean_boxes", F.coalesce("clean_boxes", F.lit(0.0)))
            .select(*by, "conf", "n_hit", "n_gt", "n_box", "n_extra", "clean_boxes"))


def operating_point(curve: DataFrame, by: list[str], max_extra: int = 4, min_recall: float = 0.9) -> DataFrame:
    """Two cuts through a curve: most recall with few extra boxes, fewest extra at enough recall.

    Ties go to the lowest threshold.
    """
    calm = F.col("n_extra") <= max_extra
    good = F.col("n_hit") >= min_recall * F.col("n_gt")
    pick = F.struct("conf", "n_hit", "n_extra")
    a = F.min_by(F.when(calm, pick), F.when(calm, F.struct(-F.col("n_hit"), F.col("conf"))))
    b = F.min_by(F.when(good, pick), F.when(good, F.struct(F.col("n_extra"), F.col("conf"))))
    return curve.groupBy(*by).agg(a.alias("calm"), b.alias("good"), F.max("n_gt").alias("n_gt")).select(
        *by, F.col("calm.conf").alias("calm_conf"), (F.col("calm.n_hit") / F.col("n_gt")).alias("calm_recall"),
        F.col("good.conf").alias("good_conf"), F.col("good.n_extra").alias("good_extra"))


def heldout_tally(results: DataFrame) -> DataFrame:
    """results(model, conf, held, source, n_hit, n_gt, n_extra): totals per source and over all."""
    keys = ["model", "conf", "held", "source"]
    out = results.rollup(*keys).agg(*[F.sum(c).alias(c) for c in ("n_hit", "n_gt", "n_extra")],
                                    *[F.grouping(k).alias(f"_g_{k}") for k in keys])
    return (out.filter("_g_held = 0").withColumn(
        "source", F.when(F.col("_g_source") == 1, F.lit("(all)")).otherwise(F.col("source")))
        .drop(*[f"_g_{k}" for k in keys]))


def detector_summary(det: DataFrame, by: list[str]) -> DataFrame:
    return det.groupBy(*by).agg(F.count(F.lit(1)).alias("n_boxes"), F.max("score").alias("max_score"),
                                F.avg(long_side()).alias("mean_side"))


def hit_scores(gt: DataFrame, det: DataFrame, by: list[str], ids: list[str], per: list[str]) -> DataFrame:
    """(by.., ids.., per.., best_score): truths that detections are centred in, with the best score for each `per` (such as
    the model) of the detections. Truths meet the detections of all models in one join."""
    d = at_point(det.select(*by, *per, "score", *G.box().named("r_")), G.box("r_").cx, G.box("r_").cy)
    return (in_buckets(gt, G.box()).join(d, [*by, "_bx", "_by"]).filter(G.center_in(G.box("r_"), G.box()))
            .groupBy(*by, *ids, *per).agg(F.max("score").alias("best_score")))


def recall_by_target(windows: DataFrame, hits: DataFrame, ids: list[str], by: list[str]) -> DataFrame:
    """Recall at each requested object size, over objects whose window could be cut.

    windows: output of target_window with a `px` column; hits: the truths that were hit.
    """
    ok = windows.filter("gx1 is not null")
    found = hits.select(*ids).withColumn("hit", F.lit(True))
    return (ok.join(found, ids, "left").groupBy(*by, "px")
            .agg(F.count(F.lit(1)).alias("n_gt"), F.count_if("hit").alias("n_hit")))


def on_person_counts(hot: DataFrame, persons: DataFrame, kept: DataFrame, by: list[str]) -> DataFrame:
    """Per scan: hot cells centred on a person, elsewhere, and whether the detector
    vetoed every one of those on a person."""
    cell = [*by, "row", "col"]
    on = touched(hot, persons.select(*by, *G.box().named("r_")), by, ["row", "col"], G.center_in)
    marked = with_flag(with_flag(hot, on, cell, "on_person"), kept, cell, "kept")
    return marked.groupBy(*by).agg(
        F.count_if("on_person").alias("n_on"), F.count_if(~F.col("on_person")).alias("n_elsewhere"),
        ((F.count_if("on_person") > 0) & (F.count_if(F.col("on_person") & F.col("kept")) == 0)).alias("all_vetoed"))


def alerts_on_target(alert_cells: DataFrame, events: DataFrame, by: list[str], scan: str = "scan_no") -> DataFrame:
    """First alert scan whose hot cells meet the event's box, per key."""
    target = events.select(*by, *G.box().named("r_"))
    met = touched(alert_cells, target, by, [scan, "row", "col"], G.intersects)
    return met.groupBy(*by).agg(F.min(scan).alias("first_on_target"))
