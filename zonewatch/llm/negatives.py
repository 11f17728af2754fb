"""Hard-negative mining by threshold joins over a pruned inverted index (after L2AP).

An anchor's positives are its best rows of the same label. A positive's negatives are the best rows of other
labels whose score lies in a window below the positive's. Both are threshold joins: all rows whose inner
product with an anchor reaches its threshold, where the threshold is lowered until the windows are full.

The index of a piece of rows (`Index`): components are taken in groups, those with the most energy first. A row
is entered under a group only while the length of what is left of it, times that of the anchors, can reach the
lowest threshold; the rest is omitted, and kept aside for verification. Rows stand in order of their last group, so
each posting list is a slice. Scores are accumulated group by group; after each, pairs are dropped whose score so
far plus the product of the remaining lengths stays below the anchor's threshold. What is left is verified whole.

Anchors (in blocks) and rows (in pieces) meet by key in two steps. In the first, one piece per block is searched
with thresholds that are lowered until the windows are full or the floor is reached. What it finds is a lower bound
of what there is, so in the second all other pieces are searched once, from those bounds on. Positives only meet
rows of their label; a hot label is many pieces. Equal (label, vector) rows are one with its few smallest ids.
Nothing is left out: a window that the bounds do not fill is searched down to its floor.

Defined cases: a row takes no part if its label or vector is null, or the vector holds a null or a non-finite
component or has a squared length of 2^62 or more after scaling. Shorter vectors count as filled with zeros. A
null id is never an anchor, is not relabelled and comes last in ties. Rows that share an id are separate rows; one
occurrence of the anchor's own (id, label, vector) is left out. A positive with a negative score has an empty window.
Anchors without positives and positives without negatives return no row. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewatch.llm import vectors as V
from zonewatch.llm.common import lookup_side
from zonewatch.session import materialize, release

SCALE = 256
POSITIVES = NEGATIVES = 5
#: The window of a positive p: LOW * p <= 100 * score <= 100 * p.
LOW = 80
GROUPS = 8
#: A threshold starts at this share of what lengths allow and is halved until it is below the last, then it is the floor.
START, LAST = 0.9, 0.05
#: Rows and anchors of one piece of the score matrix.
TILE_ROWS, TILE_ANCHORS = 4_096, 512
#: Room for rounding of bounds; it can only let more pairs through.
SLACK = 1e-9


class Index:
    """Rows by groups of components, as far as `lowest` and the anchors' lengths ask for them."""

    def __init__(self, x: np.ndarray, order: np.ndarray, cuts: list[int], anchor_rest: np.ndarray, lowest: float):
        self.cuts = cuts
        parts = x[:, order].astype(np.float64)
        rest = rests(parts, cuts)
        covered = rest * anchor_rest * (1 + SLACK) < lowest  # from this group on nothing can reach the threshold
        last = np.where(covered.any(1), covered.argmax(1), len(cuts) - 1)
        self.rows = np.argsort(-last, kind="stable")
        self.parts, self.rest, last = parts[self.rows], rest[self.rows], last[self.rows]
        self.postings = [int((last > g).sum()) for g in range(len(cuts) - 1)]

    def above(self, q: np.ndarray, rest: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (anchor, row) that may reach the anchor's threshold `least`."""
        score = np.zeros((len(q), len(self.rows)))
        alive = rest[:, :1] * self.rest[:, 0] * (1 + SLACK) >= least[:, None]
        for g, n in enumerate(self.postings):
            if not n or not alive[:, :n].any():
                break
            a, b = self.cuts[g], self.cuts[g + 1]
            score[:, :n] += q[:, a:b] @ self.parts[:n, a:b].T
            left = rest[:, g + 1:g + 2] * self.rest[:n, g + 1]
            alive[:, :n] &= score[:, :n] + left + SLACK * rest[:, :1] * self.rest[:n, 0] >= least[:, None]
        i, r = np.nonzero(alive)
        return i, self.rows[r]


def rests(parts: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Per row the length of what is left of it from each group on."""
    squares = parts ** 2
    sums = np.column_stack([squares[:, a:b].sum(1) for a, b in zip(cuts, cuts[1:])] or [np.zeros(len(parts))])
    return np.sqrt(np.column_stack([np.cumsum(sums[:, ::-1], 1)[:, ::-1], np.zeros(len(parts))]))


def join_above(q: np.ndarray, x: np.ndarray, least: np.ndarray):
    """All pairs of an anchor and a row with an inner product of at least the anchor's threshold, in parts:
    anchors, rows and exact scores."""
    order = np.argsort(-(x.astype(np.float64) ** 2).sum(0), kind="stable")
    cuts = sorted({round(i * x.shape[1] / GROUPS) for i in range(GROUPS + 1)})
    parts = q[:, order].astype(np.float64)
    rest = rests(parts, cuts)
    for at in range(0, len(x), TILE_ROWS):
        tile = x[at:at + TILE_ROWS]
        for a in range(0, len(q), TILE_ANCHORS):
            b = min(len(q), a + TILE_ANCHORS)
            index = Index(tile, order, cuts, rest[a:b].max(0), float(least[a:b].min()))
            i, r = index.above(parts[a:b], rest[a:b], least[a:b])
            for s in range(0, len(i), 1 << 17):
                ii, rr = i[s:s + (1 << 17)] + a, r[s:s + (1 << 17)]
                score = (q[ii] * tile[rr]).sum(1)
                good = score >= least[ii]
                if good.any():
                    yield ii[good], rr[good] + at, score[good]


def _grouped(q: np.ndarray, x: np.ndarray, who: np.ndarray, least: np.ndarray, keep) -> list:
    """Per anchor in `who` the (rows, scores) that reach its threshold, cut by `keep` from time to time."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in who]
    for i, r, s in join_above(q[who], x, least):
        order = np.argsort(i, kind="stable")
        i, r, s = i[order], r[order], s[order]
        heads = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        for a, b in zip(heads, [*heads[1:], len(i)]):
            n = i[a]
            found[n] = keep(int(who[n]), np.append(found[n][0], r[a:b]), np.append(found[n][1], s[a:b]))
    return found


def _first(ids: V.Ids, rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first rows by score and smallest id."""
    if len(rows) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return at[np.lexsort((ids.first[rows[at]], ids.first_none[rows[at]], -score[at]))[:k]]
    return np.arange(len(rows))


def _reach(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """No score of an anchor is larger, none smaller than its negative."""
    length = lambda y: np.sqrt((y.astype(np.float64) ** 2).sum(1))
    return length(q) * length(x).max(initial=0) * (1 + SLACK) + 1


def search_positives(q: np.ndarray, floor: np.ndarray, x: np.ndarray, ids: V.Ids, k: int):
    """Per anchor its k first entries among the rows, from `floor` (-inf: none known) on."""
    reach = _reach(q, x)
    floor = np.maximum(floor, -reach)
    least = np.where(np.isfinite(floor) & (floor > -reach), floor, START * reach)
    todo, out = np.arange(len(q)), [None] * len(q)

    def keep(_, rows, score):
        at = _first(ids, rows, score, k)
        return rows[at], score[at]
    while len(todo):
        for a, (rows, score) in zip(todo, _grouped(q, x, todo, least[todo], keep)):
            out[a] = ids.best(score, rows, k)
        full = np.array([len(out[a][0]) >= k for a in todo])
        todo = todo[~full & (least[todo] > floor[todo])]
        lower = least[todo] / 2
        least[todo] = np.where(lower < LAST * reach[todo], floor[todo], np.maximum(lower, floor[todo]))
    return out


def search_negatives(q: np.ndarray, windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], label: np.ndarray,
                     x: np.ndarray, labels: np.ndarray, ids: V.Ids, k: int):
    """windows: per anchor the upper ends, lower ends and known floors of its windows. Per anchor and window the k
    first entries of other labels in it."""
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
    out = [[empty] * len(w[0]) for w in windows]
    todo = np.array([i for i, w in enumerate(windows) if len(w[0])], np.int64)
    bottom = np.array([w[2].min() if len(w[0]) else 0 for w in windows], np.float64)
    known = np.array([bool(len(w[0])) and bool((w[2] > w[1]).all()) for w in windows])
    top = np.array([w[0].max() if len(w[0]) else 0 for w in windows], np.float64)
    step = np.maximum((top - bottom) / 4, 1)
    least = np.where(known, bottom, np.maximum(top - step, bottom))

    def keep(a, rows, score):
        other = labels[rows] != label[a]
        rows, score = rows[other], score[other]
        at = [np.zeros(0, np.int64)]
        for high, low, _ in zip(*windows[a]):
            inside = np.flatnonzero((score >= low) & (score <= high))
            at.append(inside[_first(ids, rows[inside], score[inside], k)])
        at = np.unique(np.concatenate(at))
        return rows[at], score[at]
    while len(todo):
        full = np.ones(len(todo), bool)
        for n, (a, (rows, score)) in enumerate(zip(todo, _grouped(q, x, todo, least[todo], keep))):
            for w, (high, low, _) in enumerate(zip(*windows[a])):
                inside = (score >= low) & (score <= high)
                out[a][w] = ids.best(score[inside], rows[inside], k)
                full[n] &= len(out[a][w][0]) >= k or least[a] <= max(low, windows[a][2][w])
        todo = todo[~full & (least[todo] > bottom[todo])]
        least[todo] = np.maximum(least[todo] - step[todo], bottom[todo])
    return out


def _entries(of: list, name: str, key: pa.ChunkedArray, more: dict) -> pa.Table:
    """Found entries as a table; of: (place of the anchor, entries)."""
    at = np.concatenate([np.full(len(e[0]), i) for i, e in of] or [np.zeros(0, np.int64)])
    col = lambda n, t: np.concatenate([np.asarray(e[n], t) for _, e in of] or [np.zeros(0, t)])
    got = {name: key.combine_chunks().take(pa.array(at.astype(np.int64)))} if len(of) else {name: pa.array([], pa.int64())}
    return pa.table({**got, "score": pa.array(col(0, np.int64)), "id": V.id_array(col(1, np.int64), col(2, bool)),
                     **{c: pa.array(np.concatenate([*v, np.zeros(0, t)]).astype(t)) for c, (v, t) in more.items()}})


def _numbered(df: DataFrame) -> DataFrame:
    return materialize(df.withColumn("a", F.monotonically_increasing_id()))


def _ranked(df: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return df.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)


def _positives(rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(a, nth, score, id, same): per anchor its first k + 1 entries of its label."""
    least = V.tasks(rows)
    sizes = lookup_side(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
                        .withColumn("chunks", V.pieces(F.col("n_rows"), V.CHUNK_ROWS, least)).drop("n_rows"))
    blocks = lookup_side(anchors.groupBy("label").agg(F.count(F.lit(1)).alias("n_anchors"))
                         .withColumn("blocks", V.pieces(F.col("n_anchors"), V.BLOCK_QUERIES, 1)).drop("n_anchors"))
    dealt = (rows.join(sizes, "label").join(blocks, "label")
             .select("label", "vec", "ids", V.piece_of("vec", F.col("chunks")).alias("chunk"), "blocks")
             .withColumn("block", V.each_piece(F.col("blocks"))).drop("blocks"))
    asks = (anchors.join(sizes, "label").join(blocks, "label")
            .select("a", "label", "vec", "chunks", V.piece_of("vec", F.col("blocks")).alias("block")))
    keys, schema = ["label", "block", "chunk"], "a long, score long, id long, same boolean"

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        of, same = [], []
        if left.num_rows and right.num_rows:
            q, x = V.matrices(left.column("vec"), right.column("vec"))
            floor = left.column("floor").to_numpy().astype(np.float64)
            for i, e in enumerate(search_positives(q, floor, x, V.Ids(right.column("ids")), k + 1)):
                of.append((i, e))
                same.append((x[e[3]] == q[i]).all(1))
        return _entries(of, "a", left.column("a") if left.num_rows else None, {"same": (same, bool)})
    none = F.lit(float("-inf"))
    first = materialize(asks.select("a", "label", "vec", "block", F.lit(0).alias("chunk"), none.alias("floor")).groupBy(*keys)
                        .cogroup(dealt.filter("chunk = 0").groupBy(*keys)).applyInArrow(solve, schema))
    # the last of k + 1 entries found is a score that k + 1 entries reach
    floors = first.groupBy("a").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).cast("double").alias("floor"))
    later = (asks.filter("chunks > 1").join(floors, "a", "left").withColumn("floor", F.coalesce("floor", none))
             .withColumn("chunk", V.each_piece(F.col("chunks"))).filter("chunk > 0").drop("chunks"))
    rest = later.groupBy(*keys).cogroup(dealt.filter("chunk > 0").groupBy(*keys)).applyInArrow(solve, schema)
    found = materialize(_ranked(first.unionByName(rest), ["a"], k + 1))
    release(first)
    return found


def _negatives(rows: DataFrame, anchors: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(a, high, score, id, nth): per anchor and upper end the first k entries of other labels in the window.
    wanted: (a, highs), the distinct scores of the anchor's positives."""
    least = V.tasks(rows)
    n_rows, n_asks = rows.count(), wanted.count()
    size = lambda n, most, tasks: int(max(-(-n // most), min(tasks, -(-n // V.LEAST_ROWS)), 1))
    chunks, blocks = size(n_rows, V.CHUNK_ROWS, least), size(n_asks, V.BLOCK_QUERIES, 1)
    dealt = (rows.withColumn("chunk", V.piece_of("vec", F.lit(chunks))).withColumn("block", V.each_piece(F.lit(blocks))))
    asks = anchors.join(wanted, "a").withColumn("block", V.piece_of("vec", F.lit(blocks)))
    keys, schema = ["block", "chunk"], "a long, score long, id long, high long"

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        of, ends = [], []
        if left.num_rows and right.num_rows:
            q, x = V.matrices(left.column("vec"), right.column("vec"))
            windows = []
            for highs, floors in zip(left.column("highs").to_pylist(), left.column("floors").to_pylist()):
                high = np.array(highs, np.int64)
                low = -((-LOW * high) // 100)
                floor = np.array([lo if f is None else max(f, lo) for f, lo in zip(floors, low)], np.int64)
                windows.append((high, low, floor))
            labels, own = right.column("label").to_numpy(), left.column("label").to_numpy()
            for i, per in enumerate(search_negatives(q, windows, own, x, labels, V.Ids(right.column("ids")), k)):
                for high, e in zip(windows[i][0], per):
                    of.append((i, e))
                    ends.append(np.full(len(e[0]), high))
        return _entries(of, "a", left.column("a") if left.num_rows else None, {"high": (ends, np.int64)})
    none = F.transform("highs", lambda x: F.lit(None).cast("long"))
    first = materialize(asks.withColumn("floors", none).withColumn("chunk", F.lit(0)).groupBy(*keys)
                        .cogroup(dealt.filter("chunk = 0").groupBy(*keys)).applyInArrow(solve, schema))
    floors = (first.groupBy("a", "high").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor")).filter("floor IS NOT NULL")
              .groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("high", "floor"))).alias("of_")))
    later = (asks.join(floors, "a", "left").withColumn("floors", F.transform("highs", lambda h: F.element_at("of_", h))).drop("of_")
             .withColumn("chunk", V.each_piece(F.lit(chunks))).filter("chunk > 0"))
    rest = later.groupBy(*keys).cogroup(dealt.filter("chunk > 0").groupBy(*keys)).applyInArrow(solve, schema)
    return _ranked(first.unionByName(rest), ["a", "high"], k)


def mine(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
         scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row for which
    `is_anchor` holds."""
    rows = df.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                                                          is_anchor.alias("asked"), F.col(vec_col).alias("embedding"))
    valid = V.quantised(rows, scale)
    data = materialize(V.first_ids(valid, ["label", "vec"], max(positives, negatives) + 1))
    asked = materialize(valid.filter("asked AND id IS NOT NULL").select("id", "label", "vec"))
    anchors = _numbered(asked.select("label", "vec").distinct())
    found = _positives(data, anchors, positives)
    wanted = materialize(found.filter("score >= 0").groupBy("a").agg(F.sort_array(F.collect_set("score"), asc=False).alias("highs")))
    worst = _negatives(data, anchors, wanted, negatives)

    lists = found.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("nth", "score", "id", "same"))).alias("top_"))
    own = F.coalesce(F.array_position(F.transform("top_", lambda e: e["same"] & e["id"].eqNullSafe(F.col("anchor_id"))), True), F.lit(0))
    pairs = (asked.select(F.col("id").alias("anchor_id"), "label", "vec").join(anchors, ["label", "vec"]).join(lists, "a")
             .withColumn("own", own).select("a", "anchor_id", F.explode(
                 F.slice(F.filter("top_", lambda e, i: i + 1 != F.col("own")), 1, positives)).alias("e")))
    ends = worst.groupBy("a", "high").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("worst_"))
    return (pairs.withColumn("high", F.col("e.score")).join(ends, ["a", "high"])
            .select("anchor_id", F.col("e.id").alias("positive_id"), F.col("high").alias("positive_score"), F.explode("worst_").alias("w"))
            .select("anchor_id", "positive_id", F.col("w.nth").alias("rank"), F.col("w.id").alias("negative_id"),
                    "positive_score", F.col("w.score").alias("negative_score")))
