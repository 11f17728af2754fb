"""Caps, quotas and top-k choices. Each one is the feature asked for, not a shortcut.

`row_number() <= k` lets Spark keep only k rows per key before the shuffle, so a hot key
does not reach one task whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewatch.functions.keys import hash_order


def first_k(df: DataFrame, k: int, by: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def cap_per_group(df: DataFrame, k: int, by: list[str], ids: list[str], seed: int = 0) -> DataFrame:
    """k rows per key in a repeatable random order."""
    return first_k(df, k, by, [hash_order(*[F.col(c) for c in ids], seed=seed), *ids])


def cap_candidates(df: DataFrame, max_score: int, by: list[str], score: str = "score",
                   ties=("row", "col")) -> DataFrame:
    """The strongest candidates of a scan; adds how many were left out (0 = no cap)."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if max_score <= 0:
        return df.join(sizes, by).withColumn("n_dropped", F.lit(0).cast("bigint")).drop("_n")
    top = first_k(df, max_score, by, [F.desc(score), *ties])
    return (top.join(sizes, by)
            .withColumn("n_dropped", F.greatest(F.col("_n") - max_score, F.lit(0).cast("bigint")))
            .drop("_n"))


def quota_sample(df: DataFrame, n: int, by: list[str], ids: list[str], seed: int = 0) -> DataFrame:
    """Up to max(1, n/4) rows of each source, n in all, in a repeatable random order."""
    order = hash_order(*[F.col(c) for c in ids], seed=seed)
    each = first_k(df.withColumn("_o", order), max(1, n // 4), by, ["_o", *ids])
    return each.orderBy("_o", *ids).limit(n).drop("_o")


def recent(df: DataFrame, k: int, by: list[str], time: str, ids: list[str]) -> DataFrame:
    return first_k(df, k, by, [F.desc(time), *[F.desc(c) for c in ids]])


def top_frames(boxes: DataFrame, n: int, frame: str) -> DataFrame:
    """The n frames with most objects; ties go to the earlier frame."""
    return (boxes.groupBy(frame).agg(F.count(F.lit(1)).alias("n_objects"))
            .orderBy(F.desc("n_objects"), frame).limit(n))


def largest_object(boxes: DataFrame, by: list[str]) -> DataFrame:
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    best = F.max_by(F.struct("x1", "y1", "x2", "y2"),
                    F.struct(area, -F.col("x1"), -F.col("y1"), -F.col("x2")))
    return boxes.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def warmup_window(frames: DataFrame, skip: int, take: int, by: list[str], order: str,
                  min_objects: int = 3, count: str = "n_objects") -> DataFrame:
    """Frames with enough objects, after a warm-up, as many as asked for."""
    rich = frames.filter(F.col(count) >= min_objects)
    w = Window.partitionBy(*by).orderBy(order)
    return (rich.withColumn("_rn", F.row_number().over(w))
            .filter((F.col("_rn") > skip) & (F.col("_rn") <= skip + take)).drop("_rn"))


def outcome_sample(matches: DataFrame, k: int, ids: list[str], outcome: str = "hit",
                   seed: int = 0) -> DataFrame:
    """Up to k rows of each outcome for review."""
    return cap_per_group(matches, k, [outcome], ids, seed)


def sweep(df: DataFrame, params: list[dict]) -> DataFrame:
    """Every row under every parameter set, by exploding a literal (no join)."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in params])
    return df.withColumn("_p", F.explode(rows)).select("*", "_p.*").drop("_p")
