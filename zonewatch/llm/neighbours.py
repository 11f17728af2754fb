"""Rows beside their neighbours in a global order, without one task seeing them all.

The order is cut into ranges. Each row goes to the task of its range, and the first and last row of a range
go to the range beside it as well, as guests. Every task can then walk through its ranges in order, and each
own row has its true neighbours next to it, wherever the cuts are.

The cuts come from one pass over the order's key alone: Spark deals the keys out by range, and per range its
smallest and largest key come to the driver (as many numbers as there are ranges).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewatch.llm.common import partitions

GROUP = 256


def cuts(keys: DataFrame, key: str, n: int) -> list[tuple]:
    """Per range of the non-null column `key` its smallest and largest value; equal keys share a range."""
    found = (keys.select(key).repartitionByRange(n, key).groupBy(F.spark_partition_id().alias("p"))
             .agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect())
    return sorted((r["lo"], r["hi"]) for r in found)


def _range_of(key: Column, lows: list) -> Column:
    """Number of the last range that starts at or before the key: a search in two steps."""
    at_or_before = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    if len(lows) <= GROUP:
        return at_or_before(F.lit(lows)) - 1
    group = at_or_before(F.lit(lows[::GROUP])) - 1
    return group * GROUP + at_or_before(F.slice(F.lit(lows), group * GROUP + 1, F.lit(GROUP))) - 1


def beside(rows: DataFrame, key: str, spans: list[tuple], then: list[str], round_trip: bool = False) -> DataFrame:
    """`rows` dealt out by range, with `range_` and `order_`: 1 for own rows, 0 for guests from before, 2 for
    guests from behind; sorted within tasks by both, the key and `then`. With `round_trip`, the last row of
    all is a guest before the first."""
    if not spans:
        return rows.withColumns({"range_": F.lit(0), "order_": F.lit(1)})
    lows, highs = [lo for lo, _ in spans], [hi for _, hi in spans]
    i, k, last = F.col("range_"), F.col(key), len(spans) - 1
    place = lambda r, o: F.struct(r.cast("int").alias("range_"), F.lit(o).alias("order_"))
    none = F.lit(None).cast("struct<range_:int,order_:int>")
    homes = [place(i, 1),
             F.when((i > 0) & (k == F.element_at(F.lit(lows), i + 1)), place(i - 1, 2)).otherwise(none),
             F.when((i < last) & (k == F.element_at(F.lit(highs), i + 1)), place(i + 1, 0)).otherwise(none)]
    if round_trip:
        homes.append(F.when(k == F.lit(highs[-1]), place(F.lit(0), 0)).otherwise(none))
    dealt = (rows.withColumn("range_", _range_of(k, lows)).withColumn("home_", F.explode(F.array_compact(F.array(*homes))))
             .select(*rows.columns, "home_.range_", "home_.order_"))
    return dealt.repartition(partitions(rows.sparkSession), "range_").sortWithinPartitions("range_", "order_", key, *then)
