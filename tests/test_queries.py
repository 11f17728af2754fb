"""Registered queries against their SQL. ZONEWATCH_ALL=1 runs every query (minutes)."""

import os

import pytest

from oracle import compare, connect
from zonewatch.catalog import ORACLE, QUERIES

SF = os.environ.get("ZONEWATCH_SF", "/root/testdata/sf0.01")
FEW = ["dwell_hot_cells", "confirm_n_of_m", "cooldown_dedup", "clutter_mask_fsm", "latch_alerts", "global_change_guard",
       "gated_ema_reference", "grid_cells", "gt_hits", "nms", "tile_labels", "event_recall_latency", "noise_floor",
       "clip_split", "reply_parse"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("ZONEWATCH_ALL") else FEW)
def test_query(spark, con, name):
    assert compare(spark, name, SF, con) is None


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
