"""Operator 8: mixing sources to target weights, with built-in functions only.

Sizes (words) are summed per source. The sources share the whole size by weight; a target above `cap`
times its source's size stops there and its excess is shared again by weight among the others, until none
is above. In one pass: with the sources in order of cap per weight, those that stop are the first ones, and
the level of the rest is what is left over the weight that is left. A document is emitted floor(rate)
times, and once more with probability equal to the fraction, decided by a hash of its id and text; so a
document is in the mix at most `cap` times, and reruns agree.

Defined results: the sources rank by code point, null last (a source of its own); a null text has size 0;
if all sizes are 0, so are targets and copies; rows alike in id and text share one draw; an empty table
gives an empty mix; other columns travel with the rows, and helper columns clash with none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewatch.llm.common import WORD, lookup_side

CAP = 3
WEIGHTS = (1, 2, 3)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source of (source, size): source, source_size, target, rate. One row per source goes through
    the windows; documents do not."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    per = per.withColumn("w", F.element_at(cycle, ((rank - 1) % len(weights) + 1).cast("int")))
    # stopped so far: everything of a smaller cap per weight; equal ones stop together
    before = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    per = per.withColumn("level", left.cast("double") / weight_left.cast("double"))
    free = F.col("level") * F.col("w") <= cap * F.col("source_size")
    per = per.withColumn("level", F.max(F.when(free, F.struct(-F.col("source_size") / F.col("w"), "level"))).over(everything)["level"])
    target = F.least(F.col("level") * F.col("w"), (cap * F.col("source_size")).cast("double"))
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def draw(id_col: str, text_col: str, seed: int) -> Column:
    """A number in [0, 1) fixed by the row's id and text and the seed."""
    seen = F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(seen.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 8, id_col: str = "doc_id",
           text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` and a struct column `mix_`: size, source_size, target, copies."""
    sizes = docs.select(F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    targets = lookup_side(source_targets(sizes, weights, cap)).select(
        F.col("source").alias("mix_source_"), F.struct("source_size", "target", "rate").alias("mix_rate_"))
    rate = F.col("mix_rate_.rate")
    extra = (draw(id_col, text_col, seed) < rate - F.floor(rate)).cast("long")
    made = docs.join(targets, F.col(source_col).eqNullSafe(F.col("mix_source_")))
    return made.select(*[docs[c] for c in docs.columns], F.struct(
        word_count(text_col).alias("size"), F.col("mix_rate_.source_size").alias("source_size"),
        F.col("mix_rate_.target").alias("target"), (F.floor(rate) + extra).alias("copies")).alias("mix_"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it is taken."""
    made = copies(docs, **options).filter("mix_.copies > 0")
    repeated = made.withColumn("mix_n_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_.copies"))))
    return repeated.select(*docs.columns)
