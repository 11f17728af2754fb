from zonewatch.catalog import files, gates, more, pictures, quality, recovery, reports, scans, space, streams, vision  # noqa: F401
from zonewatch.catalog.base import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
