"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "dwell_hot_cells", "confirm_n_of_m", "cooldown_dedup", "clutter_mask_fsm", "global_change_guard",
    "gated_ema_reference", "zone_fsm_batch", "topk_change_score", "latch_alerts", "event_recall_latency",
    "noise_floor", "grid_cells", "points_in_zone", "occluded_cells", "gt_hits", "recall_by_size", "iou_pairs",
    "nms", "tile_labels", "cell_components", "operating_point", "split_leakage", "reply_parse",
]


def run(spark, fn, sf: str) -> float:
    start = time.time()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    from zonewatch.catalog import QUERIES
    from zonewatch.catalog.scans import PARAMS
    from zonewatch.operators.zone_scan import pack_scans, scan_batch
    from zonewatch.session import local_session, materialize
    from zonewatch.sources.bindings import table as read_table

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus, "bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    times = {}
    for name in names:
        times[name] = run(spark, QUERIES[name], sf)
        print(f"{name:28s} {times[name]:8.3f}", file=sys.stderr, flush=True)

    # rate of the stateful job: stored vectors as scans of 200 cells, repeated as further cameras
    copies = int(os.environ.get("BENCH_CAMERAS", "1200"))
    cells = read_table(spark, sf, "embeddings").selectExpr(
        "'z0' AS zone_id", "'g' AS sig", "vec_id div 200 AS scan_no", "(vec_id div 200) * 30.0D AS t_s",
        "CAST(vec_id % 200 div 20 AS INT) AS row", "CAST(vec_id % 20 AS INT) AS col", "embedding AS desc",
        "true AS visible", "embedding[1] < 0.05 AS det_hit", "false AS sweep_hit")
    packed = pack_scans(cells, ["zone_id", "sig", "scan_no", "t_s"])
    many = materialize(packed.selectExpr(f"explode(sequence(1, {copies})) AS k", "*")
                       .selectExpr("CAST(k AS STRING) AS camera_id", "* except (k)").repartition(int(cpus), "camera_id"))
    n = many.selectExpr("count(*) AS scans", "sum(size(rows)) AS cells").first()
    rate = run(spark, lambda s, _: scan_batch(many, PARAMS), sf)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "stateful": {"sec": rate, "scans": n["scans"], "cells": int(n["cells"]),
                     "scans_per_s": round(n["scans"] / rate, 1), "cells_per_s": round(n["cells"] / rate, 1),
                     "cells_per_s_per_core": round(n["cells"] / rate / int(cpus), 1)},
        "cores": int(cpus), "spark": {"version": spark.version,
                                      "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}}))


if __name__ == "__main__":
    main()
