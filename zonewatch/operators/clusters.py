"""Connected cells, their regions, and the tiles that cover them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewatch.functions import geometry as G
from zonewatch.operators.ordered import arrange
from zonewatch.session import broadcast_if_small, has_hot_group, materialize, release

COMPONENT_CELLS = 200_000  # cells of one scan a single task may label
CALL_CELLS = 200_000  # cells of whole scans that one call is given, about
BLOCK = 512  # side of the blocks of cells in which larger scans are labelled


def lowest_labels(r: np.ndarray, c: np.ndarray, gap: int, scan: np.ndarray | None = None) -> np.ndarray:
    """Per cell (sorted by scan, row, column) the index of the lowest cell of its cluster. Scans are numbered from 0."""
    if scan is not None and len(r):
        starts = np.flatnonzero(np.diff(scan, prepend=-1))
        r = r - np.minimum.reduceat(r, starts)[scan]
        c = c - np.minimum.reduceat(c, starts)[scan]
        height = int(r.max()) + gap + 1
        if height * (int(c.max()) + 2 * gap + 1) * len(starts) >= 2 ** 62:  # too far apart for one numbering
            ends = [*starts[1:], len(r)]
            return np.concatenate([a + lowest_labels(r[a:b], c[a:b], gap) for a, b in zip(starts, ends)])
        r = r + height * scan
    width = int(c.max() - c.min()) + 2 * gap + 1
    code = (r - r.min()) * width + (c - c.min() + gap)
    a, b = [], []
    for dr in range(gap + 1):
        for dc in range(-gap if dr else 1, gap + 1):
            at = np.minimum(np.searchsorted(code, code + dr * width + dc), len(code) - 1)
            met = code[at] == code + dr * width + dc
            a.append(np.flatnonzero(met))
            b.append(at[met])
    return _settled(np.concatenate(a), np.concatenate(b), len(code))


def _settled(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Per node the lowest node that it is linked to."""
    low = np.arange(n)
    while True:
        new = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def components(cells: DataFrame, by: list[str], gap: int = 1) -> DataFrame:
    """Adds (comp_row, comp_col): the lowest cell of the transitive Chebyshev cluster."""
    cells = cells.select(*by, "row", "col").distinct()
    sizes = (cells.groupBy(*by) if by else cells.groupBy(F.lit(0))).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (sizes[0] or 0) > COMPONENT_CELLS:
        return components_by_blocks(cells, by, gap)
    return _labelled(cells, by, gap, sizes[1] or 0)


def _labelled(cells: DataFrame, by: list[str], gap: int, rows: int | None = None) -> DataFrame:
    """Labels within each group of `by`, many groups at once: a call takes about `CALL_CELLS` cells of whole groups
    (fewer where there are too few for all tasks)."""
    schema = T.StructType([*cells.schema.fields, T.StructField("comp_row", cells.schema["row"].dataType),
                           T.StructField("comp_col", cells.schema["col"].dataType)])
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deals = max(tasks, (cells.count() if rows is None else rows) // CALL_CELLS + 1)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        scan = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy(np.int64) if by else np.zeros(len(pdf), np.int64)
        r, c = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
        order = np.lexsort((c, r, scan))
        pdf, scan, r, c = pdf.iloc[order].reset_index(drop=True), scan[order], r[order], c[order]
        low = lowest_labels(r, c, gap, scan)
        pdf["comp_row"], pdf["comp_col"] = r[low], c[low]
        return pdf[schema.names]

    deal = F.pmod(F.xxhash64(*by), F.lit(deals)) if by else F.lit(0)
    return cells.withColumn("_deal", deal).repartition(deals, "_deal").groupBy("_deal").applyInPandas(label, schema)


def components_by_blocks(cells: DataFrame, by: list[str], gap: int = 1, side: int | None = None) -> DataFrame:
    """The labels of `components` for scans of any size. `cells`: distinct `by`, row, col.

    Cells are labelled per block of side x side. Those within `gap` of a border meet the ones across it, which links
    labels of adjacent blocks. The linked labels, a few per border, get the lowest label of their cluster, and cells
    take it over. Cells are shuffled once, and once more only where the linked labels are too many to broadcast.
    """
    side = max(side or BLOCK, gap)
    block = {"_br": F.floor(F.col("row") / side).cast("bigint"), "_bc": F.floor(F.col("col") / side).cast("bigint")}
    local = materialize(_labelled(cells.select(*by, "row", "col").withColumns(block), [*by, "_br", "_bc"], gap))
    links = materialize(_border_links(local, by, gap, side))
    lowest = broadcast_if_small(_lowest_linked(links, by), 200_000)
    release(links)
    joined = local.join(lowest, [*by, "comp_row", "comp_col"], "left")
    kinds = dict(local.dtypes)
    return joined.select(*by, "row", "col", *[F.coalesce(F.col(f"low.{c}"), F.col(c)).cast(kinds[c]).alias(c) for c in ("comp_row", "comp_col")])


def _border_links(local: DataFrame, by: list[str], gap: int, side: int) -> DataFrame:
    """(by, a, b): labels of cells that lie within `gap` of each other in two blocks."""
    r, c = F.col("row") - F.col("_br") * side, F.col("col") - F.col("_bc") * side
    low = lambda x: x < gap
    high = lambda x: x >= side - gap
    # each border is looked at in its later block: cells there wait, those of the earlier one visit
    waits = low(r) | low(c) | high(c)
    visits = {(0, 1): high(c), (1, -1): high(r) & low(c), (1, 0): high(r), (1, 1): high(r) & high(c)}
    place = lambda dr, dc, guest: F.struct((F.col("_br") + dr).alias("br"), (F.col("_bc") + dc).alias("bc"), F.lit(guest).alias("guest"))
    none = F.lit(None).cast("struct<br:bigint,bc:bigint,guest:boolean>")
    spots = F.array_compact(F.array(F.when(waits, place(0, 0, False)).otherwise(none),
                                    *[F.when(when, place(*at, True)).otherwise(none) for at, when in visits.items()]))
    dealt = local.withColumn("p", F.explode(spots)).select(*by, "row", "col", "comp_row", "comp_col", "p.br", "p.bc", "p.guest")
    ends = [f"{n}_{x}" for n in "ab" for x in ("row", "col")]
    schema = T.StructType([*[local.schema[c] for c in by], *[T.StructField(c, T.LongType()) for c in ends]])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"], ignore_index=True)
        r, c, guest = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64), pdf["guest"].to_numpy(bool)
        here, there = np.flatnonzero(~guest), np.flatnonzero(guest)
        pairs = []
        if len(here) and len(there):
            width = int(c.max() - c.min()) + 2 * gap + 1
            code = (r - r.min()) * width + (c - c.min() + gap)
            for dr in range(-gap, gap + 1):
                for dc in range(-gap, gap + 1):
                    want = code[there] + dr * width + dc
                    at = np.minimum(np.searchsorted(code[here], want), len(here) - 1)
                    met = code[here][at] == want
                    pairs.append(np.column_stack([there[met], here[at[met]]]))
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        labels = pdf[["comp_row", "comp_col"]].to_numpy(np.int64)
        found = np.unique(np.column_stack([labels[pairs[:, 0]], labels[pairs[:, 1]]]), axis=0)
        out = pd.DataFrame(found, columns=ends)
        for name in by:
            out[name] = pdf[name].iloc[0] if len(pdf) else None
        return out[schema.names]
    met = dealt.groupBy(*by, "br", "bc").applyInPandas(meet, schema).distinct()
    return met.select(*by, *[F.struct(F.col(f"{n}_row").alias("comp_row"), F.col(f"{n}_col").alias("comp_col")).alias(n) for n in "ab"])


def _lowest_linked(links: DataFrame, by: list[str]) -> DataFrame:
    """(by, comp_row, comp_col, low): the lowest label that a label is linked to, over any number of links."""
    if not has_hot_group(links, by, COMPONENT_CELLS):
        ends = [f"{n}_{x}" for n in "ab" for x in ("row", "col")]
        flat = links.select(*by, *[F.col(f"{n}.comp_{x}").alias(f"{n}_{x}") for n in "ab" for x in ("row", "col")])
        names = ["comp_row", "comp_col", "low_row", "low_col"]
        schema = T.StructType([*[links.schema[c] for c in by], *[T.StructField(c, T.LongType()) for c in names]])

        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            spots, at = np.unique(pdf[ends].to_numpy(np.int64).reshape(-1, 2), axis=0, return_inverse=True)
            a, b = at.reshape(-1, 2).T
            low = _settled(a, b, len(spots))
            out = pd.DataFrame(np.column_stack([spots, spots[low]]), columns=names)
            for name in by:
                out[name] = pdf[name].iloc[0]
            return out[schema.names]
        found = flat.groupBy(*by).applyInPandas(settle, schema)
        return found.select(*by, "comp_row", "comp_col", F.struct(F.col("low_row").alias("comp_row"), F.col("low_col").alias("comp_col")).alias("low"))
    both = materialize(links.unionByName(links.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))))
    now = materialize(both.select(*by, F.col("a").alias("node")).distinct().withColumn("low", F.col("node")))
    while True:
        around = both.join(now.withColumnRenamed("node", "b"), [*by, "b"]).groupBy(*by, F.col("a").alias("node")).agg(F.min("low").alias("best"))
        nearer = now.join(around, [*by, "node"]).select(*by, "node", F.least("low", "best").alias("step"), F.col("low").alias("was"))
        ahead = now.select(*by, F.col("node").alias("step"), F.col("low").alias("next"))
        new = materialize(nearer.join(ahead, [*by, "step"]).select(*by, "node", F.least("step", "next").alias("low"), "was"))
        moved = new.filter("low != was").limit(1).count()
        release(now)
        now = new
        if not moved:
            release(both)
            return now.select(*by, "node.comp_row", "node.comp_col", "low")


def hot_hull(hot: DataFrame, by: list[str]) -> DataFrame:
    """Bounds of the hot cells and their number."""
    b = G.box()
    return hot.groupBy(*by).agg(F.min(b.x1).alias("x1"), F.min(b.y1).alias("y1"),
                                F.max(b.x2).alias("x2"), F.max(b.y2).alias("y2"),
                                F.count(F.lit(1)).alias("n_cells"))


def largest_clusters(clusters: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The k clusters with most cells; ties go to the lowest cell."""
    w = Window.partitionBy(*by).orderBy(F.desc("n_cells"), "comp_row", "comp_col")
    return clusters.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def square_region(hull: G.Box, w: Column, h: Column, pad: float, min_side: float,
                  max_side: float | None) -> G.Box:
    """Square around a hull: padded, sized within limits, kept inside the frame."""
    p = hull.padded(pad)
    side = F.greatest(F.lit(min_side), p.width, p.height)
    if max_side is not None:
        side = F.least(F.lit(max_side), side)
    x1 = F.greatest(F.lit(0.0), F.least(w - side, p.cx - side / 2)).cast("int")
    y1 = F.greatest(F.lit(0.0), F.least(h - side, p.cy - side / 2)).cast("int")
    return G.Box(x1, y1, F.least(w, x1 + side).cast("int"), F.least(h, y1 + side).cast("int"))


def cluster_regions(clusters: DataFrame, pad: float = 48, min_side: float = 160,
                    max_side: float | None = 320) -> DataFrame:
    """`clusters`: hull corners plus frame_w, frame_h; adds rx1..ry2."""
    r = square_region(G.box(), F.col("frame_w"), F.col("frame_h"), pad, min_side, max_side)
    return clusters.withColumns(dict(zip(("rx1", "ry1", "rx2", "ry2"), r)))


def explode_tiles(df: DataFrame, area: G.Box, side: Column, step: Column, frame_w: Column,
                  frame_h: Column) -> DataFrame:
    """Tiles of one size covering an area, row by row; adds tile_no, tx1..ty2."""
    xs = G.axis_positions(area.x1, area.x2, side, step)
    ys = G.axis_positions(area.y1, area.y2, side, step)
    out = (df.withColumns({"_xs": xs, "_side": side})
           .select("*", F.posexplode(ys).alias("_iy", "ty1"))
           .select("*", F.posexplode("_xs").alias("_ix", "tx1")))
    return out.withColumns({
        "tile_no": F.col("_iy") * F.size("_xs") + F.col("_ix"),
        "tx2": F.least(frame_w, F.col("tx1") + F.col("_side")),
        "ty2": F.least(frame_h, F.col("ty1") + F.col("_side"))}).drop("_xs", "_iy", "_ix", "_side")


def thin(df: DataFrame, max_n: int, by: list[str], order: list[str]) -> DataFrame:
    """At most max_n rows per key: every k-th with k = ceil(n / max_n). Adds n and n_kept.

    This is the sampling the operator stands for; the loss is reported in the columns.
    """
    ranked = arrange(df, by, order).rank("_rn").done()
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    k = F.ceil(F.col("n") / F.lit(max_n))
    out = ranked.join(sizes, by).filter(((F.col("_rn") - 1) % k == 0) & ((F.col("_rn") - 1) / k < max_n))
    return out.withColumn("n_kept", F.least(F.ceil(F.col("n") / k), F.lit(max_n).cast("bigint"))).drop("_rn")


def cover_tiles(clusters: DataFrame, scale: float, max_side: int = 320, min_extra: int = 96,
                pad: int = 48) -> DataFrame:
    """Small tiles covering a whole cluster instead of one window at its centre."""
    w, h = F.col("frame_w"), F.col("frame_h")
    b = G.box()
    area = G.Box(F.greatest(F.lit(0), b.x1 - pad), F.greatest(F.lit(0), b.y1 - pad),
                 F.least(w, b.x2 + pad), F.least(h, b.y2 + pad))
    side = max(min_extra, int(max_side * scale))
    return explode_tiles(clusters, area, F.lit(side), F.lit(max(8, side // 2)), w, h)


def sweep_tiles(zones: DataFrame, max_side: int = 320, escalate_scale: float = 0.4,
                min_extra: int = 96, pad: int = 48) -> DataFrame:
    """Half-overlapping tiles over the padded hull of a whole zone."""
    w, h = F.col("frame_w"), F.col("frame_h")
    b = G.box()
    area = G.Box(F.greatest(F.lit(0), b.x1 - pad).cast("int"), F.greatest(F.lit(0), b.y1 - pad).cast("int"),
                 F.least(w, b.x2 + pad).cast("int"), F.least(h, b.y2 + pad).cast("int"))
    side = max(min_extra, int(max_side * escalate_scale)) if 0 < escalate_scale < 1 else max_side
    return explode_tiles(zones, area, F.lit(side), F.lit(max(1, side // 2)), w, h)
