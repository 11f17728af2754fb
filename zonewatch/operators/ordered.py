"""Windows over ordered sequences that stay correct and parallel for hot keys.

A plain window puts every row of a key into one task. `arrange` keeps that plan while
no key is too large. Otherwise it range-partitions the rows by (key, order), so that a
hot key spreads over many slices, and each window becomes: window inside the slice,
one total per slice, running combination of those totals, join back. Results are the
same on both plans.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewatch.session import has_hot_group, hot_rows, materialize

SLICE = "_slice"
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a + b, a, b)
    return F.greatest(a, b) if kind == "max" else F.least(a, b)


def slices(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Range-partition by (key, order) and keep the partition number as a column."""
    spark = df.sparkSession
    rows = df.count()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * rows // hot_rows(spark) + 1)
    ranged = df.repartitionByRange(n, *by, *order)
    return materialize(ranged.withColumn(SLICE, F.spark_partition_id()))


def join_back(df: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that matches NULL keys too and keeps one copy of the key columns."""
    renamed = side.select([F.col(k).alias(f"_k_{k}") for k in keys]
                          + [c for c in side.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys])
    return df.join(renamed, cond, "left").drop(*[f"_k_{k}" for k in keys])


def _along(order: list[str], forward: bool) -> list[Column]:
    """The order or its exact reverse: nulls, first in ascending order, are last in descending order."""
    return [F.col(c).asc_nulls_first() if forward else F.col(c).desc_nulls_last() for c in order]


@dataclass(frozen=True)
class Ordered:
    df: DataFrame
    by: list[str]
    order: list[str]
    split: bool

    def _with(self, df: DataFrame) -> "Ordered":
        return Ordered(df, self.by, self.order, self.split)

    @property
    def _keys(self) -> list[str]:
        return self.by + [SLICE] if self.split else self.by

    def _window(self, forward: bool = True):
        return Window.partitionBy(*self._keys).orderBy(*(_along(self.order, forward)))

    def select(self, *cols) -> "Ordered":
        return self._with(self.df.select(*cols))

    def with_columns(self, cols: dict[str, Column]) -> "Ordered":
        return self._with(self.df.withColumns(cols))

    def running(self, exprs: dict[str, tuple[str, Column]]) -> "Ordered":
        """Inclusive prefix aggregates: name -> (sum | max | min, expression)."""
        return self._scan(exprs, forward=True)

    def remaining(self, exprs: dict[str, tuple[str, Column]]) -> "Ordered":
        """Inclusive suffix aggregates, from the row to the end of its key."""
        return self._scan(exprs, forward=False)

    def _scan(self, exprs, forward: bool) -> "Ordered":
        # a suffix is the prefix of the reversed order: Spark adds each row once to a frame that grows, but
        # works a frame that shrinks out anew for every row
        local = self._window(forward).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = self.df.withColumns({n: _AGG[k](e).over(local) for n, (k, e) in exprs.items()})
        if not self.split:
            return self._with(df)
        totals = self.df.groupBy(*self._keys).agg(
            *[_AGG[k](e).alias(f"_t_{n}") for n, (k, e) in exprs.items()])
        across = (Window.partitionBy(*self.by).orderBy(*_along([SLICE], forward))
                  .rowsBetween(Window.unboundedPreceding, -1))
        carry = totals.select(*self._keys, *[_AGG[k](f"_t_{n}").over(across).alias(f"_c_{n}")
                                             for n, (k, _) in exprs.items()])
        df = join_back(df, carry, self._keys)
        df = df.withColumns({n: _combine(k, F.col(n), F.col(f"_c_{n}"))
                             for n, (k, _) in exprs.items()})
        return self._with(df.drop(*[f"_c_{n}" for n in exprs]))

    def rank(self, name: str = "rn") -> "Ordered":
        """1-based position inside the key."""
        if not self.split:
            return self._with(self.df.withColumn(
                name, F.row_number().over(self._window()).cast("bigint")))
        return self.running({name: ("sum", F.lit(1).cast("bigint"))})

    def lag(self, exprs: dict[str, Column]) -> "Ordered":
        """Values of the previous row of the key."""
        w = self._window()
        df = self.df.withColumns({n: F.lag(e).over(w) for n, e in exprs.items()})
        if not self.split:
            return self._with(df)
        last = self.df.groupBy(*self._keys).agg(
            F.max_by(F.struct(*[e.alias(n) for n, e in exprs.items()]),
                     F.struct(*self.order)).alias("_last"))
        across = Window.partitionBy(*self.by).orderBy(SLICE)
        carry = last.select(*self._keys, F.lag("_last").over(across).alias("_before"))
        df = join_back(df.withColumn("_pos", F.row_number().over(w)), carry, self._keys)
        first = F.col("_pos") == 1
        df = df.withColumns({n: F.when(first, F.col("_before")[n]).otherwise(F.col(n))
                             for n in exprs})
        return self._with(df.drop("_pos", "_before"))

    def tail(self, exprs: dict[str, tuple[str, Column]], m: int) -> "Ordered":
        """Aggregates over the last m rows, the current one included."""
        if not self.split:
            w = self._window().rowsBetween(-(m - 1), 0)
            return self._with(self.df.withColumns(
                {n: _AGG[k](e).over(w) for n, (k, e) in exprs.items()}))
        # Blocks of ranks; the last m-1 rows of a block are lent to the next one.
        size = max(hot_rows(self.df.sparkSession), m)
        ranked = self.rank("_rn").df
        block = F.floor((F.col("_rn") - 1) / size)
        lent = (F.pmod(F.col("_rn") - 1, F.lit(size)) >= size - (m - 1)) if m > 1 else F.lit(False)
        blocks = F.when(lent, F.array(block, block + 1)).otherwise(F.array(block))
        spread = ranked.withColumn("_home", block).withColumn("_block", F.explode(blocks))
        w = Window.partitionBy(*self.by, "_block").orderBy("_rn").rowsBetween(-(m - 1), 0)
        out = spread.withColumns({n: _AGG[k](e).over(w) for n, (k, e) in exprs.items()})
        return self._with(out.filter("_home = _block").drop("_rn", "_home", "_block"))

    def done(self) -> DataFrame:
        return self.df.drop(SLICE)


def arrange(df: DataFrame, by: list[str], order: list[str]) -> Ordered:
    """Prepare ordered windows over `by`; `order` (ascending) must be total inside a key."""
    by, order = list(by), list(order)
    if has_hot_group(df, by):
        return Ordered(slices(df, by, order), by, order, True)
    return Ordered(df, by, order, False)


def order_statistics(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """One row per distinct (key, value) with the 0-based rank range [lo, hi) it covers.

    Values are counted first, so duplicates never travel; `n` is the size of the key.
    """
    counted = (df.filter(F.col(value).isNotNull()).groupBy(*by, value)
               .agg(F.count(F.lit(1)).alias("_cnt")))
    line = arrange(counted, by, [value]).running({"hi": ("sum", F.col("_cnt"))})
    if by and not line.split:  # same partitioning: no further shuffle
        ranged = line.df.withColumn("n", F.sum("_cnt").over(Window.partitionBy(*by)))
    else:
        totals = counted.groupBy(*by).agg(F.sum("_cnt").alias("n"))
        # without keys the total is exactly one row
        ranged = join_back(line.done(), totals, by) if by else line.done().crossJoin(F.broadcast(totals))
    return ranged.withColumn("lo", F.col("hi") - F.col("_cnt")).drop("_cnt")


def value_at(stats_value: str, position: Column) -> Column:
    """Aggregate: the value whose rank range holds `position` (use after order_statistics)."""
    holds = (F.col("lo") <= position) & (position < F.col("hi"))
    return F.max(F.when(holds, F.col(stats_value)))


def exact_percentiles(df: DataFrame, by: list[str], value: str,
                      named: dict[str, float]) -> DataFrame:
    """Linear-interpolation percentiles without holding a key's values in one buffer."""
    stats = order_statistics(df, by, value)
    aggs = []
    for name, p in named.items():
        pos = F.lit(p) * (F.col("n") - 1)
        aggs += [value_at(value, F.floor(pos)).alias(f"_lo_{name}"),
                 value_at(value, F.ceil(pos)).alias(f"_hi_{name}"),
                 F.max(pos - F.floor(pos)).alias(f"_f_{name}")]
    out = stats.groupBy(*by).agg(F.max("n").alias("n"), *aggs)
    return out.select(*by, "n", *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
        for n in named])


def indexed_values(df: DataFrame, by: list[str], value: str,
                   named: dict[str, Column]) -> DataFrame:
    """Values at sorted positions given as expressions of the key size `n` (0-based)."""
    stats = order_statistics(df, by, value)
    return stats.groupBy(*by).agg(
        F.max("n").alias("n"), *[value_at(value, pos).alias(name) for name, pos in named.items()])
