"""Grades, bands and statuses: small CASE projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")

# The band edges used by the reports (half-open, first match).
PX_BANDS = [("0-12", 0, 12), ("12-20", 12, 20), ("20-32", 20, 32), ("32-48", 32, 48),
            ("48-80", 48, 80), ("80+", 80, INF)]
FRACTION_BANDS = [("<2%", 0, .02), ("2-5%", .02, .05), ("5-12%", .05, .12),
                  ("12-40%", .12, .40), (">=40%", .40, 9.9)]
COARSE_BANDS = [("<25", 0, 25), ("25-45", 25, 45), (">=45", 45, INF)]

# Pixel density grades (px per metre) and smallest workable bottle (px).
DENSITY_GRADES = [(62.5, "below detection"), (125.0, "detection"), (250.0, "recognition")]
BOTTLE_GOOD_PX, BOTTLE_MIN_PX = 40.0, 25.0


def band(value: Column, bands: list[tuple[str, float, float]]) -> Column:
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(bands):
        inside = value >= lo
        if hi != INF:
            inside = inside & (value < hi)
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def in_band(value: Column, lo: float = 0.06, hi: float = 0.40) -> Column:
    """Both ends included."""
    return value.between(lo, hi)


def density_grade(px_per_cm: Column) -> Column:
    per_m = px_per_cm * 100
    out = F.lit("identification")
    for limit, name in reversed(DENSITY_GRADES):
        out = F.when(per_m < limit, F.lit(name)).otherwise(out)
    return out


def bottle_verdict(bottle_px: Column) -> Column:
    return (F.when(bottle_px >= BOTTLE_GOOD_PX, F.lit("good"))
            .when(bottle_px >= BOTTLE_MIN_PX, F.lit("marginal")).otherwise(F.lit("infeasible")))


def cell_for_object(object_px: Column) -> Column:
    """Cell size about 2.2 objects wide on a 16 px lattice, kept in 32..192.

    0 where no grid is needed (large objects) or none helps (too small).
    """
    raw = F.bround(2.2 * object_px / 16) * 16
    sized = F.least(F.greatest(raw, F.lit(32)), F.lit(192)).cast("int")
    marginal = (object_px >= BOTTLE_MIN_PX) & (object_px < BOTTLE_GOOD_PX)
    return F.when(marginal, sized).otherwise(F.lit(0))


def cell_status(hot: Column, muted: Column, score: Column) -> Column:
    return (F.when(hot, F.lit("hot")).when(muted, F.lit("muted"))
            .when(score > 0, F.lit("warm")).otherwise(F.lit("grid")))


def scan_tag(alert: Column, reseed: Column, dirty: Column) -> Column:
    return (F.when(alert, F.lit("alert")).when(reseed, F.lit("reseed"))
            .when(dirty, F.lit("dirty")).otherwise(F.lit("clean")))


def usable_negative(std: Column, mean: Column, drone: Column, min_std: float = 16.0,
                    max_mean: float = 200.0) -> Column:
    """Flat or (outside aerial sources) very bright tiles teach nothing."""
    return (std >= min_std) & (drone | (mean <= max_mean))


def rate_per_day(n: Column, hours: Column) -> Column:
    """No rate is extrapolated from less than two hours."""
    return F.when(hours >= 2.0, n / F.greatest(hours / 24.0, F.lit(1e-9)))


def rate_verdict(rate: Column) -> Column:
    return (F.when(rate.isNull(), F.lit("too short")).when(rate < 1, F.lit("pass"))
            .when(rate < 2, F.lit("acceptable")).otherwise(F.lit("fail")))
