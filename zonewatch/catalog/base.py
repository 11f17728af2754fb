"""Registry of runnable queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return register


# --- the bindings of sources/bindings.py, restated in SQL --------------------------

OBS = """obs AS (
  SELECT event_type AS zone, user_id, event_id, CAST(user_id // 16 AS INTEGER) AS "row",
         CAST(user_id % 16 AS INTEGER) AS col, epoch_us(ts) AS t_us, value, value >= 50 AS changed
  FROM events)"""

DAILY = OBS + """, daily AS (
  SELECT DISTINCT zone, CAST(t_us // 86400000000 AS INTEGER) AS day, "row", col FROM obs WHERE value >= 100),
cells AS (SELECT *, col*32 AS x1, "row"*32 AS y1, col*32+64 AS x2, "row"*32+64 AS y2 FROM daily)"""

LOG = OBS + """, log AS (
  SELECT zone, t_us // 3600000000 AS scan_no, CAST((t_us // 3600000000) * 3600 AS DOUBLE) AS t_s,
         count(*) FILTER (value >= 100) >= 1 AS dirty, count(*) FILTER (value >= 100) >= 2 AS alert,
         count(*) FILTER (value >= 100) AS n_hot, count(*) FILTER (changed) AS n_changed,
         count(*) AS n_cells,
         coalesce(string_agg(DISTINCT "row" || ',' || col, ' ' ORDER BY "row" || ',' || col)
           FILTER (value >= 100), '') AS hot_cells,
         greatest(count(*) FILTER (changed) - 3, 0) AS n_dropped,
         count(*) FILTER (changed) - count(*) FILTER (value >= 100) AS n_verify_dropped,
         count(*) FILTER (value >= 100) AS n_verify_boxes,
         count(*) FILTER (value >= 100) % 2 AS n_muted_hit,
         max(value) / 100 AS shift_px, sum(value) AS ms,
         least(1.0::DOUBLE, ((t_us // 3600000000 + 10) % 97) / 60.0::DOUBLE) AS mask_progress
  FROM obs GROUP BY zone, t_us // 3600000000)"""

BOXES = """boxes AS (
  SELECT DISTINCT l_orderkey AS image, CAST(l_partkey*37 % 400 AS DOUBLE) AS x1,
         CAST(l_suppkey*53 % 200 AS DOUBLE) AS y1,
         CAST(l_partkey*37 % 400 + (l_quantity*4+8) AS DOUBLE) AS x2,
         CAST(l_suppkey*53 % 200 + (round_even(l_tax*1000,0)+10) AS DOUBLE) AS y2,
         round_even(l_discount*10,2) AS score, l_linestatus AS kind, l_returnflag AS model
  FROM lineitem),
gt AS (SELECT DISTINCT image,x1,y1,x2,y2 FROM boxes WHERE kind='F'),
det AS (SELECT image,x1,y1,x2,y2,max(score) AS score FROM boxes WHERE kind='O' GROUP BY ALL)"""

ZONES = """zpts AS (
  SELECT s_suppkey AS camera_id, (s_suppkey % 40)/100.0::DOUBLE AS a, (s_suppkey*7 % 40)/100.0::DOUBLE AS b
  FROM supplier),
zpoly AS (
  SELECT camera_id,
    CAST(round_even(a*640,0) AS INTEGER) AS px1, CAST(round_even(b*480,0) AS INTEGER) AS py1,
    CAST(round_even((a+0.40::DOUBLE)*640,0) AS INTEGER) AS px2, CAST(round_even((b+0.05::DOUBLE)*480,0) AS INTEGER) AS py2,
    CAST(round_even((a+0.45::DOUBLE)*640,0) AS INTEGER) AS px3, CAST(round_even((b+0.50::DOUBLE)*480,0) AS INTEGER) AS py3,
    CAST(round_even((a+0.02::DOUBLE)*640,0) AS INTEGER) AS px4, CAST(round_even((b+0.45::DOUBLE)*480,0) AS INTEGER) AS py4
  FROM zpts),
zbox AS (
  SELECT *, greatest(0, least(px1,px2,px3,px4)) AS bx1, greatest(0, least(py1,py2,py3,py4)) AS by1,
         least(640, greatest(px1,px2,px3,px4)) AS bx2, least(480, greatest(py1,py2,py3,py4)) AS by2
  FROM zpoly)"""


def inside_sql(x: str, y: str) -> str:
    """Even-odd test against the four edges of a zpoly row."""
    edges = []
    for i in range(4):
        ax, ay = f"px{i + 1}", f"py{i + 1}"
        j = (i + 1) % 4 + 1
        bx, by = f"px{j}", f"py{j}"
        edges.append(f"CASE WHEN ({ay} > {y}) <> ({by} > {y}) THEN CAST({x} < CAST({bx}-{ax} AS DOUBLE)"
                     f"*({y}-{ay})/nullif({by}-{ay},0)+{ax} AS INTEGER) ELSE 0 END")
    return "((" + " + ".join(edges) + ") % 2 = 1)"


def positions_sql(lo: str, hi: str, cell: int, step: int) -> str:
    """List of cell starts on one axis."""
    return (f"CASE WHEN {hi}-{lo} <= {cell} THEN [{lo}] "
            f"ELSE list_sort(list_distinct(list_concat(range({lo}, {hi}-{cell}+1, {step}), [{hi}-{cell}]))) END")


def inter_sql(a: str, b: str) -> str:
    return (f"(greatest(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1),0)"
            f"*greatest(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1),0))")


def area_sql(a: str) -> str:
    return f"(({a}.x2-{a}.x1)*({a}.y2-{a}.y1))"


def iou_sql(a: str, b: str) -> str:
    i = inter_sql(a, b)
    return f"({i}/({area_sql(a)}+{area_sql(b)}-{i}+1e-9))"


def touches_sql(a: str, b: str) -> str:
    return f"({a}.x1<{b}.x2 AND {a}.x2>{b}.x1 AND {a}.y1<{b}.y2 AND {a}.y2>{b}.y1)"


def center_sql(d: str, g: str) -> str:
    return (f"(({d}.x1+{d}.x2)/2 BETWEEN {g}.x1 AND {g}.x2 AND ({d}.y1+{d}.y2)/2 BETWEEN {g}.y1 AND {g}.y2)")
