"""Descriptor arithmetic on 64-value arrays, as Catalyst array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 8  # fixed: the score averages the 8 largest of 64 differences


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def mean_removed(arr: Column) -> Column:
    mean = _total(arr) / F.size(arr)
    return F.transform(arr, lambda v: v.cast("double") - mean)


def change_score(desc: Column, ref: Column, k: int = TOP) -> Column:
    """Mean of the k largest absolute differences; infinite without a reference."""
    diffs = F.zip_with(desc, ref, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    top = F.slice(F.sort_array(diffs, asc=False), 1, k)
    return F.when(ref.isNull(), F.lit(float("inf"))).otherwise(_total(top) / F.size(top))


def changed(score: Column, thr: float) -> Column:
    return score >= thr


def ema(ref: Column, desc: Column, alpha: float) -> Column:
    blended = F.zip_with(ref, desc, lambda r, d: (1 - alpha) * r + alpha * d)
    return F.when(ref.isNull(), desc).otherwise(blended)


def softmax(logits: Column) -> Column:
    """Stable softmax over an array of logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v.cast("double") - top.cast("double")))
    return F.transform(e, lambda v: v / _total(e))


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit.cast("double")))


def normalised(arr: Column, mean: float, std: float) -> Column:
    return F.transform(arr, lambda v: (v.cast("double") / 255.0 - mean) / std)
