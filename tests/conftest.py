import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from zonewatch.session import DEFAULT_HOT_ROWS, HOT_ROWS_CONF, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "tests")
    s.conf.set("spark.sql.shuffle.partitions", "2")
    s.conf.set("spark.sql.adaptive.enabled", "false")  # tiny inputs: fewer stages
    return s


@pytest.fixture
def hot(spark):
    """Treat keys of more than 60 rows as hot, so that the sliced plans run."""
    spark.conf.set(HOT_ROWS_CONF, "60")
    yield 60
    spark.conf.set(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS))
