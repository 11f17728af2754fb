import random
import uuid

import pytest
from pyspark.sql import functions as F
from test_zone_scan import P, spark_scans

from zonewatch.operators import zone_scan as Z
from zonewatch.params import ScanParams
from zonewatch.plans import runlog
from zonewatch.session import shared_dir
from zonewatch.streaming import metrics as M
from zonewatch.streaming import ordered as O
from zonewatch.streaming import run as R
from zonewatch.streaming import snapshots as SN

PARAMS = ScanParams(**{**P.__dict__, "verify_on": True})
NAMES = ["camera_id", "scan_no", "n_hot", "n_changed", "alert", "rearmed", "global_change", "n_occluded", "max_run", "late"]


def table(df, names=NAMES):
    return sorted(tuple(str(r[n]) for n in names) for r in df.collect())


START = 1_000_000  # a watermark starts at 0, and rows at it are late


def timed(df):
    return df.withColumn("ts", F.timestamp_micros(((F.col("t_s") + START) * 1e6).cast("bigint")))


def ticked(rows, at_s):
    """A row behind all others that only carries time."""
    tick = rows.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ("ts", "kind")],
                                F.timestamp_seconds(F.lit(at_s + START)).alias("ts"), F.lit("tick").alias("kind"))
    return rows.unionByName(tick.drop("batch").withColumn("batch", F.lit(99)))


def source(spark, rows, batches):
    """rows with a column `batch` as a stream that delivers one batch after the other."""
    path = R.stage_batches(rows, "batch", batches)
    return spark.readStream.schema(rows.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def scans(spark):
    return Z.complete_scans(spark_scans(spark)).persist()


@pytest.fixture(scope="module")
def control(spark):
    rows = [("c0", "z", 95.0, "reset_all"), ("c1", "z", 90.0, "reset"), ("c1", "z", 100.0, "reset"), ("c1", "z", 120.0, "unmute:1,1"),
            ("c2", "z", 200.0, "remove"), ("c2", "z", 5000.0, "reset")]
    return spark.createDataFrame(rows, "camera_id string, zone_id string, t_s double, order string")


def arrivals(rows, seed, batches, spread):
    """Each row comes in the batch of its time, or up to `spread` batches later."""
    at = F.floor((F.unix_seconds("ts") - START) / 60) + F.floor(F.rand(seed) * (spread + 1))
    return rows.withColumn("batch", F.least(at, F.lit(batches - 1)).cast("int"))


@pytest.mark.parametrize("seed,spread,delay", [(1, 0, "0 seconds"), (2, 3, "600 seconds")])
def test_scans_and_orders_in_any_arrival_order(spark, scans, control, seed, spread, delay):
    batch = Z.scan_batch(Z.with_control(scans, control), PARAMS)
    rows = O.with_orders(timed(scans), timed(control).filter("t_s < 5000"))
    stream = source(spark, ticked(arrivals(rows, seed, 6, spread), 9000), [0, 1, 2, 3, 4, 5, 99])
    got = R.run_available(O.zones_in_order(stream, PARAMS, delay))
    assert table(got) == table(batch)
    assert {(r["camera_id"], r["scan_no"], r["event"]) for r in got.filter("event != 'scan'").collect()} == {("c2", 7, "removed")}


def test_idle_zones_are_forgotten(spark, scans):
    gap = scans.filter("NOT (camera_id = 'c0' AND scan_no BETWEEN 3 AND 8)")
    rows = O.with_orders(timed(gap))
    stream = source(spark, ticked(rows.withColumn("batch", (F.col("scan_no") / 5).cast("int")), 331), [0, 1, 2, 99])
    got = R.run_available(O.zones_in_order(stream, PARAMS, "0 seconds", idle_s=100.0))
    idle = got.filter("event = 'idle'").select("camera_id", "t_s").collect()
    assert [tuple(r) for r in idle] == [("c0", 160.0)]  # 331 s is less than 100 s after the last scans
    fresh = Z.scan_batch(gap.filter("camera_id = 'c0' AND scan_no > 8"), PARAMS)
    assert table(got.filter("event = 'scan' AND camera_id = 'c0' AND scan_no > 8")) == table(fresh)


def play(spark, stream, name, base, **options):
    q = (O.zones_in_order(stream, PARAMS, "0 seconds", snapshot_every=4, **options).writeStream
         .foreachBatch(SN.save_snapshots(f"{base}/states", f"{base}/rows", fold=3, run=name))
         .option("checkpointLocation", f"{base}/checkpoint-{name}").trigger(availableNow=True).start())
    q.awaitTermination()


def test_snapshots_and_restart(spark, scans, control):
    base = f"{shared_dir(spark)}/snap-{uuid.uuid4().hex}"
    assert SN.load_snapshots(spark, f"{base}/states").count() == 0
    whole = Z.with_control(scans, control.filter("t_s < 5000"))
    batch = table(Z.scan_batch(whole, PARAMS))
    part = lambda low, high: O.with_orders(timed(scans.filter(f"scan_no >= {low} AND scan_no < {high}")),
                                           timed(control.filter(f"t_s >= {low * 30 - 29} AND t_s <= {high * 30 - 30}"))).withColumn(
                                               "batch", ((F.unix_seconds("ts") - START) / 60).cast("int"))
    play(spark, source(spark, ticked(part(0, 9), 250), [0, 1, 2, 3, 4, 99]), "a", base)
    pointer = SN.read_pointer(spark, f"{base}/states")
    assert pointer["base"] is not None and len(pointer["parts"]) < 3
    saved = {r["camera_id"]: r for r in SN.load_snapshots(spark, f"{base}/states").collect()}
    # c2 was removed before its eighth scan and has not reached a fourth since
    assert set(saved) == {"c0", "c1"} and all(r["t_s"] >= 210.0 for r in saved.values())
    grids = spark.createDataFrame([("c0", "z", "g"), ("c1", "z", "other")], "camera_id string, zone_id string, sig string")
    assert [r["camera_id"] for r in SN.load_snapshots(spark, f"{base}/states", grids).collect()] == ["c0"]
    # the run is lost; a new one starts from the snapshots and reads again what came after them
    states = SN.load_snapshots(spark, f"{base}/states")
    rest = (O.with_orders(timed(scans)).join(states.select("camera_id", "zone_id", F.col("t_s").alias("seen")), ["camera_id", "zone_id"])
            .filter("t_s > seen").drop("seen").withColumn("batch", (F.col("scan_no") / 6).cast("int")))
    play(spark, source(spark, ticked(rest, 9000), [0, 1, 99]), "b", base, initial=states.drop("t_s"))
    again = spark.read.parquet(f"{base}/rows/run=b")
    want = [r for r in batch if r[0] in saved and 30.0 * int(r[1]) > saved[r[0]]["t_s"]]
    assert table(again) == want and want
    after = {r["camera_id"]: r["t_s"] for r in SN.load_snapshots(spark, f"{base}/states").collect()}
    assert all(after[c] >= saved[c]["t_s"] for c in saved)


def test_episodes_over_batches(spark):
    rng = random.Random(3)
    rows = [(z, i, 60.0 * i, rng.random() < 0.4, rng.random() < 0.3, rng.random() < 0.25, rng.randrange(9)) for z in "abc" for i in range(60)]
    log = spark.createDataFrame(rows, "zone string, scan_no bigint, t_s double, alert boolean, escalated boolean, rearmed boolean, n_hot int")
    want = runlog.alert_sessions(log, ["zone"], ["scan_no"])
    rows = timed(log).withColumn("batch", F.least(F.floor(F.col("scan_no") / 10 + F.rand(5)), F.lit(5)).cast("int"))
    tick = rows.limit(1).select(F.lit("a").alias("zone"), F.lit(-1).cast("bigint").alias("scan_no"), F.timestamp_seconds(F.lit(9999 + START)).alias("ts"), F.lit(99).alias("batch"))
    stream = source(spark, rows.unionByName(tick, allowMissingColumns=True), [0, 1, 2, 3, 4, 5, 99])
    got = O.latest_episodes(R.run_available(O.episodes_in_order(stream, ["zone"])), ["zone"])
    names = ["zone", "episode", "t_start", "t_end", "n_alerts", "max_hot"]
    assert table(got, names) == table(want, names) and want.count() > 6


def test_late_rows_are_counted(spark, scans):
    # batch 2 is dropped against what batch 0 has seen: the watermark in force is that of the batch before
    rows = O.with_orders(timed(scans)).withColumn("batch", (F.col("scan_no") / 4).cast("int"))
    rows = rows.withColumn("batch", F.when(F.col("scan_no") == 1, 2).otherwise(F.col("batch")))
    base = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    counts = M.BatchCounts(spark, f"{base}/counts")
    spark.streams.addListener(counts)
    try:
        out = O.zones_in_order(source(spark, ticked(rows, 9000), [0, 1, 2, 99]), PARAMS, "0 seconds")
        R.run_available(out, counts=counts)
        got = M.read_counts(spark, f"{base}/counts").agg(F.sum("n_rows"), F.sum("n_late")).first()
    finally:
        spark.streams.removeListener(counts)
    assert tuple(got) == (37, 3)


def test_with_control_takes_each_order_once(spark):
    scans = spark.createDataFrame([("c", "z", i, 30.0 * i, float(i)) for i in range(6)] + [("d", "z", 0, 0.0, 1.0)],
                                  "camera_id string, zone_id string, scan_no bigint, t_s double, other double")
    orders = [("c", "z", 30.0, "a"), ("c", "z", 31.0, "b"), ("c", "z", 31.0, "c"), ("c", "z", 59.0, "a"), ("c", "z", 999.0, "x"), ("e", "z", 1.0, "y")]
    got = Z.with_control(scans.repartition(3), spark.createDataFrame(orders, "camera_id string, zone_id string, t_s double, order string").repartition(4))
    assert {(r["camera_id"], r["scan_no"]): r["control"] for r in got.collect() if r["control"]} == {("c", 1): "a", ("c", 2): "a"}
    assert got.count() == 7 and got.agg(F.sum("other")).first()[0] == 16.0


