"""The check for hot keys, and how often their slices run."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from zonewatch.operators import replay as RP
from zonewatch.session import has_hot_group, largest_group


def test_an_exploded_key_is_seen(spark):
    few = spark.range(1).select(F.lit("k").alias("key"), F.explode(F.sequence(F.lit(1), F.lit(300_000))).alias("i"))
    assert largest_group(few, ["key"]) == 300_000
    assert has_hot_group(few, ["key"], 200_000) and not has_hot_group(few, ["key"], 300_000)


def counter():
    """A machine that never forgets: a running total."""
    def step(state, cols):
        out = []
        for v in cols["v"]:
            state = (state or 0) + int(v)
            out.append(state)
        return state, {"total": out}
    return step


def test_rows_are_read_a_fixed_number_of_times(spark, hot, monkeypatch):
    made = []
    original = RP.materialize
    monkeypatch.setattr(RP, "materialize", lambda df: made.append(1) or original(df))
    rows = spark.range(700).select(F.lit("a").alias("key"), "id", (F.col("id") % 3).alias("v"))
    got = {r["id"]: r["total"] for r in RP.replay(rows, ["key"], ["id"], counter(), "total bigint").collect()}
    want = np.cumsum(np.arange(700) % 3)
    assert got == {i: int(want[i]) for i in range(700)}
    assert -(-700 // hot) == 12 and len(made) <= 4 + 4 * RP.ROUNDS + 3  # however many slices there are


def test_keys_that_forget_and_keys_that_do_not(spark, hot):
    """One key is settled in the first round, one never; one has a single slice."""
    def step(state, cols):
        out = []
        for k, v in zip(cols["key"], cols["v"]):
            state = int(v) if k == "f" and v % 20 == 0 else (state or 0) + int(v)
            out.append(state)
        return state, {"total": out}
    rows = spark.range(1500).select(F.when(F.col("id") % 3 == 0, "f").when(F.col("id") % 3 == 1, "n").otherwise("m").alias("key"), "id",
                                    (F.col("id") * 7 % 101).alias("v")).filter("key <> 'm' OR id < 100")
    got = {(r["key"], r["id"]): r["total"] for r in RP.replay(rows, ["key"], ["id"], step, "total bigint").collect()}
    states, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["id"]):
        k = r["key"]
        states[k] = r["v"] if k == "f" and r["v"] % 20 == 0 else states.get(k, 0) + r["v"]
        want[k, r["id"]] = states[k]
    assert got == want


def test_ids_beyond_double_stay_whole(spark):
    big = (1 << 53) + 1
    rows = spark.createDataFrame([("a", 1, big, 1), ("a", 2, None, 1), ("b", 1, big + 2, 1)], "key string, t int, id bigint, v bigint")
    got = {(r["key"], r["t"]): (r["id"], r["total"]) for r in RP.replay(rows, ["key"], ["t"], counter(), "total bigint").collect()}
    assert got == {("a", 1): (big, 1), ("a", 2): (None, 2), ("b", 1): (big + 2, 1)}
    batch = pa.record_batch([pa.array([big, None])], names=["id"])
    assert RP._exact(batch, ["id"])["id"][0] == big


def test_a_suffix_takes_in_each_row_once(spark):
    """The rest of a key is an aggregate that grows from the end; a frame that shrinks costs the square of the rows."""
    from zonewatch.operators.ordered import arrange
    df = spark.range(40).select((F.col("id") % 2).alias("k"), F.when(F.col("id") > 3, F.col("id")).alias("t"), F.col("id").alias("u"),
                                (F.col("id") * 7 % 11).alias("v"))
    rest = arrange(df, ["k"], ["t", "u"]).remaining({"low": ("min", F.col("v")), "n": ("sum", F.lit(1))}).done()
    assert "unboundedfollowing" not in rest._jdf.queryExecution().executedPlan().toString().lower()
    rows = sorted(rest.collect(), key=lambda r: (r.k, -1 if r.t is None else r.t, r.u))
    for r in rows:
        later = [x for x in rows if x.k == r.k and (-1 if x.t is None else x.t, x.u) >= (-1 if r.t is None else r.t, r.u)]
        assert (r.low, r.n) == (min(x.v for x in later), len(later))


def test_first_scan_after_grows_one_frame(spark):
    from zonewatch.plans import runlog
    at = lambda n, **k: spark.range(n).select(F.lit("z").alias("zone"), *[e.alias(c) for c, e in k.items()])
    events = at(30, event_id=F.col("id"), t=(F.col("id") * 7 % 30).cast("double"))
    scans = at(5, scan_no=F.col("id"), ts_=(F.col("id") * 5).cast("double"))
    out = runlog.first_scan_after(events, scans, ["zone"], "t", "ts_", "scan_no")
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()
    got = {r.event_id: r.scan_no for r in out.collect()}
    assert got == {i: (-(-(i * 7 % 30) // 5) if i * 7 % 30 <= 20 else None) for i in range(30)}
