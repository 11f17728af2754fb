import random

import pytest
from pyspark.sql import functions as F

from zonewatch.operators import gates
from zonewatch.operators.ordered import arrange, exact_percentiles, indexed_values


def sequence(spark, flags, extra=None):
    return spark.createDataFrame([("k", i, i * 30_000_000, bool(f)) for i, f in enumerate(flags)],
                                 "key string, seq bigint, t_us bigint, present boolean")


def passed(df, col):
    return [r[col] for r in df.orderBy("seq").collect()]


def test_confirm_needs_n_of_m(spark):
    c = lambda flags: passed(gates.confirm(sequence(spark, flags), F.col("present"), 4, 6, ["key"], ["seq"]), "passed")
    assert c([1, 1, 1, 1]) == [False, False, False, True]
    assert not any(c([1, 0, 1, 0, 1, 0]))
    assert c([1] * 10 + [0] * 6)[-1] is False


def test_cooldown_first_passes_and_window_is_closed_below(spark):
    df = spark.createDataFrame([("k", i, int(t * 1e6)) for i, t in enumerate([0, 1799, 1801, 3600, 3601])],
                               "key string, seq bigint, t_us bigint")
    assert passed(gates.cooldown(df, 1800, ["key"], ["seq"]), "passed") == [True, False, True, False, True]


def clutter(spark, flags, **kw):
    out = gates.clutter_mask(sequence(spark, flags), ["key"], ["seq"], dirty="present", min_scans=100, mute_ratio=0.98,
                             unmute_after=20, **kw)
    return passed(out, "muted")


def test_clutter_mutes_at_the_minimum_and_unmutes_after_clean(spark):
    m = clutter(spark, [1] * 100)
    assert m[98] is False and m[99] is True
    assert not any(clutter(spark, [i % 3 == 0 for i in range(200)]))
    assert not any(clutter(spark, [i % 10 != 0 for i in range(500)]))
    m = clutter(spark, [1] * 100 + [0] * 20)
    assert m[118] is True and m[119] is False


def brute_dwell(rows):
    run, out = 0, []
    for changed, visible in rows:
        if visible:
            run = run + 1 if changed else 0
        out.append(run)
    return out


@pytest.fixture(scope="module")
def noisy():
    rng = random.Random(5)
    big = [("big", i, rng.random() < 0.7, rng.random() < 0.8, rng.randint(0, 9)) for i in range(160)]
    small = [("small", i, rng.random() < 0.5, True, rng.randint(0, 9)) for i in range(12)]
    return big + small


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, seq bigint, changed boolean, visible boolean, v bigint")


@pytest.mark.parametrize("sliced", [False, True])
def test_windows_on_both_plans(spark, noisy, sliced, request):
    if sliced:
        request.getfixturevalue("hot")
    df = frame(spark, noisy)
    assert arrange(df, ["key"], ["seq"]).split is sliced
    got = {}
    d = gates.dwell(df, F.col("changed"), ["key"], ["seq"], F.col("visible"))
    got["run"] = {(r.key, r.seq): r.run for r in d.collect()}
    c = gates.confirm(df, F.col("changed"), 3, 7, ["key"], ["seq"])
    got["confirm"] = {(r.key, r.seq): r.passed for r in c.collect()}
    p = gates.persist_from(df, F.col("v"), 1, ["key"], ["seq"])
    got["persist"] = {(r.key, r.seq): r.persists for r in p.collect()}
    g = gates.previous(df, {"before": F.col("v")}, ["key"], ["seq"])
    got["lag"] = {(r.key, r.seq): r.before for r in g.collect()}
    for key in ("big", "small"):
        rows = [r for r in noisy if r[0] == key]
        runs = brute_dwell([(r[2], r[3]) for r in rows])
        for i, r in enumerate(rows):
            at = (key, r[1])
            assert got["run"][at] == runs[i]
            assert got["confirm"][at] == (sum(x[2] for x in rows[max(0, i - 6):i + 1]) >= 3)
            assert got["persist"][at] == all(x[4] >= 1 for x in rows[i:])
            assert got["lag"][at] == (rows[i - 1][4] if i else None)


@pytest.mark.parametrize("sliced", [False, True])
def test_replayed_gates_on_both_plans(spark, noisy, sliced, request):
    if sliced:
        request.getfixturevalue("hot")
    df = frame(spark, noisy).withColumn("t_us", F.col("seq") * 7_000_000 + F.col("v") * 100_000)
    fired = {(r.key, r.seq): r.fired for r in gates.confirm_and_clear(
        df, 3, 5, ["key"], ["seq"], present="changed").collect()}
    passed_ = {(r.key, r.seq): r.passed for r in gates.cooldown(df, 33, ["key"], ["seq"]).collect()}
    muted = {(r.key, r.seq): r.muted for r in gates.clutter_mask(
        df, ["key"], ["seq"], dirty="changed", min_scans=6, mute_ratio=0.7, unmute_after=2).collect()}
    assert len(fired) == len(passed_) == len(muted) == len(noisy)
    for key in ("big", "small"):
        recent, last, total, litter, streak, mute = [], None, 0, 0, 0, False
        for r in (x for x in noisy if x[0] == key):
            recent = (recent + [r[2]])[-5:]
            ok = sum(recent) >= 3
            recent = [] if ok else recent
            assert fired[key, r[1]] == ok
            t = r[1] * 7_000_000 + r[4] * 100_000
            go = last is None or t - last >= 33_000_000
            last = t if go else last
            assert passed_[key, r[1]] == go
            total, litter, streak = total + 1, litter + r[2], 0 if r[2] else streak + 1
            if mute and streak >= 2:
                total = litter = streak = 0
                mute = False
            elif not mute:
                mute = total >= 6 and litter / total >= 0.7
            assert muted[key, r[1]] == mute


def test_cooldown_that_never_forgets_on_slices(spark, hot):
    """Evenly spaced rows: every start state leads elsewhere, the fixpoint must still be exact."""
    rows = [("k", i, i * 1_000_000) for i in range(130)]
    df = spark.createDataFrame(rows, "key string, seq bigint, t_us bigint")
    got = passed(gates.cooldown(df, 7, ["key"], ["seq"]), "passed")
    assert got == [i % 7 == 0 for i in range(130)]


@pytest.mark.parametrize("sliced", [False, True])
def test_percentiles_and_positions(spark, noisy, sliced, request):
    import numpy as np
    if sliced:
        request.getfixturevalue("hot")
    df = frame(spark, noisy).withColumn("x", F.col("v") * 1.5 + F.col("seq") % 40)
    p = {r.key: r for r in exact_percentiles(df, ["key"], "x", {"p50": .5, "p999": .999}).collect()}
    m = {r.key: r for r in indexed_values(df, ["key"], "x", {"mid": F.floor(F.col("n") / 2)}).collect()}
    for key in ("big", "small"):
        xs = [r[4] * 1.5 + r[1] % 40 for r in noisy if r[0] == key]
        assert p[key].p50 == pytest.approx(np.percentile(xs, 50))
        assert p[key].p999 == pytest.approx(np.percentile(xs, 99.9))
        assert m[key].mid == sorted(xs)[len(xs) // 2]


def latch(spark, scans, **kw):
    rows = [("z", i, i * 30.0, [c[0] for c in s], [c[1] for c in s]) for i, s in enumerate(scans)]
    df = spark.createDataFrame(rows, "zone string, seq bigint, t_s double, hot_rows array<int>, hot_cols array<int>")
    return gates.latch_alerts(df, ["zone"], ["seq"], **kw).orderBy("seq").collect()


def test_latch_alerts_once_then_again_after_clearing(spark):
    out = latch(spark, [[(1, 1)]] * 40 + [[]] * 5 + [[(1, 1)]] * 10, n=1, m=1)
    assert [r.seq for r in out if r.alert] == [0, 45]
    assert [r.seq for r in out if r.rearmed] == [43]


def test_latch_second_place_and_growth(spark):
    out = latch(spark, [[(1, 1)], [(1, 1), (2, 2)], [(1, 1), (9, 9)], [(9, 9)]], n=1, m=1, merge_radius=2)
    assert [(r.alert, r.escalated) for r in out] == [(True, False), (False, False), (True, True), (False, False)]


def test_cooldown_mode_repeats(spark):
    out = latch(spark, [[(1, 1)]] * 130, n=1, m=1, mode="cooldown", cooldown_s=1800)
    assert [r.seq for r in out if r.alert] == [0, 60, 120]


def test_interval_sampling_is_greedy(spark):
    df = spark.createDataFrame([("k", i, int(t * 1e6)) for i, t in enumerate([0, 29, 31, 59, 61, 92])],
                               "key string, seq bigint, t_us bigint")
    assert sorted(r.seq for r in gates.sample_interval(df, 30, ["key"], ["seq"]).collect()) == [0, 2, 4, 5]
