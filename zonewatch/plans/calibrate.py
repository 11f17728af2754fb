"""Thresholds from clean footage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewatch.functions.grading import (bottle_verdict, cell_for_object, density_grade)
from zonewatch.operators.ordered import exact_percentiles, join_back

# Object lengths in cm used to grade a site.
BOTTLE_CM, BAG_CM, SACK_CM = 22.0, 35.0, 50.0


def clip(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def noise_floor(scores: DataFrame, shifts: DataFrame, jitter: DataFrame, by: list[str],
                min_scans: int = 10) -> DataFrame:
    """Change threshold, dead zone and jitter verdict from clean scans.

    scores(by, score, scan_no), shifts(by, px), jitter(by, px). Sites with too few scans
    get NULL thresholds.
    """
    s = exact_percentiles(scores, by, "score", {"p50": .5, "p99": .99, "p999": .999})
    n = scores.groupBy(*by).agg(F.count_distinct("scan_no").alias("n_scans"))
    sp = exact_percentiles(shifts, by, "px", {"s50": .5, "s99": .99}).drop("n")
    j = exact_percentiles(jitter, by, "px", {"j99": .99}).drop("n")
    out = s.withColumnRenamed("n", "n_scores")
    for side in (n, sp, j):
        out = join_back(out, side, by)
    return _settings(out, min_scans)


def _settings(out: DataFrame, min_scans: int) -> DataFrame:
    enough = F.col("n_scans") >= min_scans
    return out.withColumns({
        "thr": F.when(enough, clip(1.5 * F.col("p999"), 4.0, 10.0)),
        "min_px": F.when(enough, clip(1.5 * F.coalesce("s99", F.lit(0.0)), 2.0, 6.0)),
        "jitter_high": F.coalesce("j99", F.lit(0.0)) > 6.0,
        "noisy": F.when(enough, clip(1.5 * F.col("p999"), 4.0, 10.0) >= 9.5)})


#: Size of the quantile sketches: ranks are off by about 0.05 % of the values at most (two-sided, 99 % of the time).
SKETCH = 8192


def value_sketches(values: DataFrame, by: list[str], value: str, scan: str | None = None) -> DataFrame:
    """(by.., n, sketch, scans): mergeable sketches of the values, e.g. per site and day, to be stored. `scans` counts
    distinct scans, as a sketch too."""
    scans = F.hll_sketch_agg(scan) if scan else F.lit(None).cast("binary")
    return values.groupBy(*by).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH).alias("sketch"), scans.alias("scans"))


def merged_quantiles(sketches: DataFrame, by: list[str], named: dict[str, float]) -> DataFrame:
    """(by.., n, n_scans, ..): quantiles over all sketches of a key. The cost follows the number of sketches, not of
    values, so a site is calibrated anew each day from its stored days."""
    out = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH).alias("_k"), F.hll_union_agg("scans").alias("_h"))
    return out.select(*by, "n", F.hll_sketch_estimate("_h").alias("n_scans"),
                      *[F.kll_sketch_get_quantile_double("_k", F.lit(float(p))).alias(name) for name, p in named.items()])


def noise_floor_sketch(scores: DataFrame, shifts: DataFrame, jitter: DataFrame, by: list[str], min_scans: int = 10) -> DataFrame:
    """`noise_floor` from stored sketches (`value_sketches`; of the scores with scans): the same columns."""
    s = merged_quantiles(scores, by, {"p50": .5, "p99": .99, "p999": .999}).withColumnRenamed("n", "n_scores")
    sp = merged_quantiles(shifts, by, {"s50": .5, "s99": .99}).drop("n", "n_scans")
    j = merged_quantiles(jitter, by, {"j99": .99}).drop("n", "n_scans")
    return _settings(join_back(join_back(s, sp, by), j, by), min_scans)


def calibrate_threshold(scores: DataFrame, by: list[str], margin: float = 1.5,
                        score: str = "score") -> DataFrame:
    """Classifier threshold above everything seen on clean scans, with exceedances."""
    p = exact_percentiles(scores, by, score, {"p50": .5, "p90": .9, "p99": .99, "p999": .999})
    top = scores.groupBy(*by).agg(F.max(score).alias("max_score"), F.count_distinct("scan_no").alias("n_scans"))
    thr = join_back(p, top, by).withColumn("thr", clip(F.col("max_score") * margin, 0.05, 0.9))
    over = (join_back(scores, thr.select(*by, "thr"), by).groupBy(*by).agg(
        F.count_if(F.col(score) >= F.col("thr")).alias("n_thr"),
        F.count_if(F.col(score) >= 0.3).alias("n_03"), F.count_if(F.col(score) >= 0.6).alias("n_06")))
    out = join_back(thr, over, by)
    scans = F.greatest(F.lit(1), F.col("n_scans"))
    return out.withColumns({"per_scan_thr": F.col("n_thr") / scans, "per_scan_03": F.col("n_03") / scans,
                            "per_scan_06": F.col("n_06") / scans, "few": F.col("n") < 200,
                            "high": F.col("max_score") > 0.5})


def site_density(points: DataFrame) -> DataFrame:
    """points(.., length_px, length_cm): pixel density, its grade and a cell size."""
    per_cm = F.col("length_px") / F.col("length_cm")
    out = points.withColumn("px_per_cm", per_cm)
    d = F.col("px_per_cm")
    return out.withColumns({
        "bottle_px": d * BOTTLE_CM, "bag_px": d * BAG_CM, "sack_px": d * SACK_CM,
        "grade": density_grade(d), "verdict": bottle_verdict(d * BOTTLE_CM),
        "cell_px": cell_for_object(d * BOTTLE_CM)})


def check_tuning(configs: DataFrame) -> DataFrame:
    """Configurations whose threshold was tuned for other weights."""
    base = F.element_at(F.split("weights", "/"), -1)
    return configs.filter((F.col("tuned_for") != "") & (base != F.col("tuned_for")))
