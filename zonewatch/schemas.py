"""Fixed schemas; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
          "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "binary": T.BinaryType()}
_TYPES.update({f"array<{n}>": T.ArrayType(t) for n, t in list(_TYPES.items())})
_TYPES.update({"array<float>": T.ArrayType(T.FloatType()), "array<array<double>>": T.ArrayType(_TYPES["array<double>"])})


def _struct(columns: str) -> T.StructType:
    """Flat column lists; built without a session so that workers can import them."""
    pairs = [c.strip().split(" ") for c in columns.split(",")]
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in pairs])


FRAMES = _struct("camera_id string, scan_no bigint, ts timestamp, width int, height int, channels int, data binary")
ZONES = _struct("camera_id string, zone_id string, points array<array<double>>, frame_w int, frame_h int")
CELLS = _struct("camera_id string, zone_id string, sig string, row int, col int, x1 int, y1 int, x2 int, y2 int")
ZONE_FILE = "points array<array<double>>"
TRUTH_FILE = "intervals array<array<double>>"
COCO_PARTS = {
    "images": "id bigint, file_name string, width double, height double, flickr_url string, coco_url string, flickr_640_url string",
    "annotations": "id bigint, image_id bigint, category_id bigint, bbox array<double>",
    "categories": "id bigint, name string, supercategory string"}
COCO_FILE = ", ".join(f"{name} array<struct<{fields}>>" for name, fields in COCO_PARTS.items())

# One row per scan, written by the live run.
SCAN_LOG = _struct(
    "t_s double, dirty int, alert int, escalated int, n_hot int, n_raw_hot int, n_cells int, n_occluded int, "
    "n_changed int, n_scored int, n_dropped int, n_muted_hit int, shift_px double, stab_px double, "
    "stab_deg double, n_verify_dropped int, n_verify_boxes int, mask_progress double, global_change int, "
    "ref_reset int, n_sweep_hot int, n_escalated_hot int, max_run int, verify_failed int, verify_conf double, "
    "ms double, hot_cells string, notes string")

# Input of the zone scan: the visible cells of one scan as aligned arrays.
#   desc       64 values per cell, one after the other
#   det_hit    cell touched by a detection; NULL array = the detector failed
#   fine_hit   same for the finer second look, sweep_hit for the sweep of the whole zone
#   det_boxes  what the detector saw, [x1, y1, x2, y2, confidence] each; fine_boxes, sweep_boxes likewise
#   score      classifier score per cell (classifier mode)
#   control    'reset' | 'reset_all' | 'remove' | 'unmute:<row>,<col>', applied before the scan
SCANS = _struct(
    "camera_id string, zone_id string, scan_no bigint, t_s double, sig string, n_cells int, "
    "rows array<int>, cols array<int>, desc array<float>, det_hit array<boolean>, fine_hit array<boolean>, "
    "sweep_hit array<boolean>, det_boxes array<array<double>>, fine_boxes array<array<double>>, "
    "sweep_boxes array<array<double>>, score array<double>, shift_px double, stab_fits boolean, stab_px double, "
    "control string")

SCAN_RESULT = _struct(
    "late boolean, dirty boolean, alert boolean, escalated boolean, rearmed boolean, n_fresh int, n_hot int, "
    "n_raw_hot int, n_occluded int, n_changed int, n_scored int, n_dropped int, n_muted_hit int, "
    "n_verify_dropped int, n_sweep_hot int, n_escalated_hot int, max_run int, mask_progress double, "
    "global_change boolean, ref_reset boolean, verify_failed boolean, anchor_refreshed boolean, "
    "hot_rows array<int>, hot_cols array<int>, max_change double, verify_boxes array<array<double>>, verify_conf double")

REF_STATE = _struct("camera_id string, zone_id string, sig string, row int, col int, desc array<double>")
CLUTTER_STATE = _struct("camera_id string, zone_id string, sig string, row int, col int, total bigint, "
                       "litter bigint, clean_streak bigint, muted boolean")
