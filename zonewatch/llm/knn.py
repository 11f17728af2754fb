"""Exact top-k search as a Voronoi kNN join.

Largest inner product is smallest distance once every vector x gets one more component, sqrt(M^2 - |x|^2), M the
largest length, and every query a zero: |q - x|^2 = |q|^2 + M^2 - 2 q.x. In that space

1. some vectors are pivots, and each vector belongs to the cell of its nearest one;
2. a summary per cell of the data holds its size, its largest distance and its k + 1 smallest ones to the pivot;
   |q - pivot| + such a distance bounds the distance of a true neighbour, so the (k + 1)-th smallest of all these
   sums bounds how far the neighbours of q can be;
3. a summary per cell of the queries holds the largest distance to the pivot and the largest such bound;
4. a vector goes to a group of query cells only if the triangle inequality leaves it within the bound of one of
   them; each group is solved in pieces of bounded size, exactly, in whole numbers; the best k + 1 of each piece
   meet at the end.

Pivots only steer the work: any choice gives the same result. They are at most `MAX_PIVOTS` vectors with the
smallest hashes (the only sample here). Equal vectors are one vector with its k + 1 smallest ids, equal queries
are one query, so neither makes a large group. Where vectors have no clusters, bounds cannot exclude much and
each group of queries meets all vectors, in pieces: that is the block form of the join.

Defined cases: a vector that is null, holds a null or a non-finite component, or has a squared length of 2^62
or more after scaling takes no part, neither as query nor as candidate. Shorter vectors count as filled with
zeros; a vector without components scores 0 with all. A null id is never a query, and comes after all others in
ties. Rows that share an id are separate rows: only one occurrence of the query's own (id, vector) is left out.
A query with fewer than k other rows gets all of them; without queries or vectors the result is empty. Other
columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewatch.llm import vectors as V
from zonewatch.session import materialize, release

SCALE = 1024
MAX_PIVOTS = 1_024
#: Room for rounding in distances, as a share of the largest length; it can only let more vectors through.
SLACK = 1e-5


class Cells:
    """Pivots, and distances to them in the space with one more component."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.top = top  # M^2
        self.pivots = self.raised(pivots)
        self.squares = (self.pivots ** 2).sum(1)
        self.between = np.sqrt(np.maximum(self.squares[:, None] + self.squares - 2 * self.pivots @ self.pivots.T, 0))

    def raised(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.top - (x ** 2).sum(1), 0))])

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        y = np.column_stack([x.astype(np.float64), np.zeros(len(x))]) if query else self.raised(x)
        return np.sqrt(np.maximum((y ** 2).sum(1)[:, None] + self.squares - 2 * y @ self.pivots.T, 0))

    def home(self, x: np.ndarray, query: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances to all pivots, the nearest pivot and the distance to it."""
        all_ = self.distances(x, query)
        cell = all_.argmin(1)
        return all_, cell, all_[np.arange(len(x)), cell]


def _parts(table, size: int = 4_096):
    for at in range(0, table.num_rows, size):
        yield table.slice(at, size)


def _summaries(data: DataFrame, cells: Cells, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per data cell: size, largest distance, and its k smallest distances (inf where there are fewer)."""
    def run(batches):
        near: dict[int, np.ndarray] = {}
        n, far = np.zeros(len(cells.pivots), np.int64), np.zeros(len(cells.pivots))
        for batch in batches:
            for part in _parts(batch):
                _, cell, d = cells.home(V.matrix(part.column("vec"), width))
                order = np.lexsort((d, cell))
                cell, d = cell[order], d[order]
                heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else []
                for i, j in zip(heads, [*heads[1:], len(cell)]):
                    c = int(cell[i])
                    n[c], far[c] = n[c] + j - i, max(far[c], d[j - 1])
                    near[c] = np.sort(np.append(near.get(c, np.zeros(0)), d[i:min(j, i + k)]))[:k]
        got = sorted(near)
        yield pa.record_batch([pa.array(got, pa.int32()), pa.array(n[got], pa.int64()), pa.array(far[got], pa.float64()),
                               pa.array([near[c].tolist() for c in got], pa.list_(pa.float64()))], names=["cell", "n", "far", "near"])
    some = data.select("vec").mapInArrow(run, "cell int, n long, far double, near array<double>")
    m = len(cells.pivots)
    n, far, near = np.zeros(m, np.int64), np.zeros(m), np.full((m, k), np.inf)
    nearest = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k)  # k numbers of each task that has the cell
    for r in some.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"), nearest.alias("near")).collect():  # MAX_PIVOTS rows
        n[r["cell"]], far[r["cell"]] = r["n"], r["far"]
        near[r["cell"], :len(r["near"])] = r["near"]
    return n, far, near


def _query_cells(queries: DataFrame, cells: Cells, near: np.ndarray, width: int, k: int) -> list:
    """Per query cell: number of queries, largest distance to the pivot, largest bound of a k-th neighbour."""
    def run(batches):
        for batch in batches:
            for part in _parts(batch, 1_024):
                all_, cell, d = cells.home(V.matrix(part.column("vec"), width), query=True)
                reach = np.empty(len(cell))
                for i in range(len(cell)):
                    sums = (all_[i][:, None] + near).ravel()
                    reach[i] = np.partition(sums, k - 1)[k - 1] if len(sums) >= k else np.inf
                yield pa.record_batch([part.column("vec"), pa.array(cell, pa.int32()), pa.array(d), pa.array(reach)],
                                      names=["vec", "cell", "d", "reach"])
    dealt = queries.select("vec").mapInArrow(run, "vec binary, cell int, d double, reach double")
    return dealt, dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d"), F.max("reach").alias("reach"))


def _walk(between: np.ndarray, cells: list[int]) -> list[int]:
    """The cells in an order in which each is followed by the nearest one left."""
    left, out = list(cells), []
    while left:
        at = left[int(np.argmin(between[out[-1]][left]))] if out else left[0]
        left.remove(at)
        out.append(at)
    return out


def nearest(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows of every row for which `is_query` holds."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.lit(None).cast("long").alias("label"),
                     is_query.alias("asked"), F.col(vec_col).alias("embedding"))
    all_rows = V.quantised(rows, scale)
    data = materialize(V.first_ids(all_rows, ["vec"], k + 1))
    asked = materialize(all_rows.filter("asked AND id IS NOT NULL").select("id", "vec"))
    queries = materialize(asked.select("vec").distinct())

    def lengths(batches):
        for batch in batches:
            for part in _parts(batch):
                x = V.matrix(part.column("vec"))
                yield pa.record_batch([pa.array([x.shape[1]], pa.int32()), pa.array([float((x.astype(float) ** 2).sum(1).max(initial=0))])],
                                      names=["width", "top"])
    size = data.select("vec").mapInArrow(lengths, "width int, top double").agg(F.max("width"), F.max("top")).first()
    n, n_queries = data.count(), queries.count()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n or not n_queries:
        release(data, asked, queries)
        return spark.createDataFrame([], schema)
    width, top = size[0], size[1]

    m = int(min(MAX_PIVOTS, max(1, 2 * round(n ** 0.5))))
    picked = data.select("vec", F.xxhash64("vec").alias("h")).orderBy("h", "vec").limit(m).collect()  # MAX_PIVOTS vectors
    cells = Cells(V.matrix(pa.array([bytes(r["vec"]) for r in picked], pa.binary()), width), top)
    counts, far, near = _summaries(data, cells, width, k + 1)
    dealt, by_cell = _query_cells(queries, cells, near, width, k + 1)
    found = {r["cell"]: r for r in by_cell.collect()}  # MAX_PIVOTS rows

    # groups of query cells that lie close together; a cell with too many queries is split
    group, parts, size_ = np.full(len(cells.pivots), -1, np.int32), [], 0
    for c in _walk(cells.between, sorted(found)):
        if not parts or size_ + found[c]["n"] > V.BLOCK_QUERIES:
            parts.append(1)
            size_ = 0
        group[c], size_ = len(parts) - 1, size_ + found[c]["n"]
        parts[-1] = -(-size_ // V.BLOCK_QUERIES)
    asking = np.array(sorted(found), np.int64)
    reach = np.array([(found[c]["reach"] + found[c]["d"]) for c in asking])
    room = reach * (1 + SLACK) + SLACK * top ** 0.5  # within this distance of a query's pivot lies all its queries need
    # what a group may need, from the summaries alone, sets the number of pieces
    needed = np.zeros(len(parts))
    for j in np.flatnonzero(counts):
        for g in np.unique(group[asking[cells.between[asking, j] - far[j] <= room]]):
            needed[g] += counts[j]
    small = max(1, V.tasks(df) // max(1, sum(parts)))
    chunks = np.maximum(np.maximum(np.ceil(needed / V.CHUNK_ROWS), np.minimum(small, np.ceil(needed / V.LEAST_ROWS))), 1).astype(np.int32)
    of_group = group[asking]

    def send(batches):
        for batch in batches:
            for part in _parts(batch, 2_048):
                x = V.matrix(part.column("vec"), width)
                _, cell, d = cells.home(x)
                close = cells.between[cell][:, asking] - d[:, None] <= room
                wanted = np.zeros((len(x), len(parts)), bool)
                for g in range(len(parts)):
                    wanted[:, g] = close[:, of_group == g].any(1)
                r, g = np.nonzero(wanted)
                chunk = part.column("h").to_numpy()[r] % chunks[g]
                times = np.array(parts)[g]
                at = np.repeat(np.arange(len(r)), times)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.record_batch([pa.array(g[at], pa.int32()), pa.array(nth, pa.int32()), pa.array(chunk[at], pa.int32()),
                                       part.column("vec").take(pa.array(r[at])), part.column("ids").take(pa.array(r[at]))],
                                      names=["g", "part", "chunk", "vec", "ids"])
    hashed = data.select("vec", "ids", F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(1 << 31)).alias("h"))
    sent = hashed.mapInArrow(send, "g int, part int, chunk int, vec binary, ids array<long>")
    place = F.lit([int(x) for x in group])
    asks = (dealt.select("vec", F.element_at(place, F.col("cell") + 1).alias("g"))
            .withColumn("part", F.pmod(F.xxhash64("vec"), F.element_at(F.lit([int(x) for x in parts]), F.col("g") + 1)).cast("int"))
            .withColumn("chunk", V.each_piece(F.element_at(F.lit([int(x) for x in chunks]), F.col("g") + 1))))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            q, ids = V.matrix(left.column("vec"), width), V.Ids(right.column("ids"))
            x = V.matrix(right.column("vec"), width)
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)  # scores and rows so far
            step = max(1, (1 << 22) // len(q))
            for at in range(0, len(x), step):
                found = V.products(q, x[at:at + step])
                for i in range(len(q)):
                    s, r = np.append(best[i][0], found[i]), np.append(best[i][1], np.arange(at, at + found.shape[1]))
                    if len(s) > k + 1:
                        near_ = s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                        s, r = s[near_], r[near_]
                        order = np.lexsort((ids.first[r], ids.first_none[r], -s))[:k + 1]
                        s, r = s[order], r[order]
                    best[i] = s, r
            for i, (s, r) in enumerate(best):
                score, id_, none, of = ids.best(s, r, k + 1)
                out.append((np.full(len(score), i), score, id_, none, (x[of] == q[i]).all(1)))
        if not out:
            return pa.table({"vec": pa.array([], pa.binary()), "score": pa.array([], pa.int64()), "id": pa.array([], pa.int64()),
                             "same": pa.array([], pa.bool_())})
        i, score, id_, none, same = (np.concatenate(c) for c in zip(*out))
        return pa.table({"vec": left.column("vec").combine_chunks().take(pa.array(i)), "score": pa.array(score),
                         "id": V.id_array(id_, none), "same": pa.array(same)})
    keys = ["g", "part", "chunk"]
    solved = asks.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(solve, "vec binary, score long, id long, same boolean")
    order = Window.partitionBy("vec").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    top_ = solved.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    lists = top_.groupBy("vec").agg(F.sort_array(F.collect_list(F.struct("nth", "score", "id", "same"))).alias("top_"))
    own = F.coalesce(F.array_position(F.transform("top_", lambda e: e["same"] & e["id"].eqNullSafe(F.col("query_id"))), True), F.lit(0))
    others = F.filter("top_", lambda e, i: i + 1 != F.col("own"))
    joined = asked.select(F.col("id").alias("query_id"), "vec").join(lists, "vec").withColumn("own", own)
    return (joined.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "e"))
            .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("e.id").alias("vec_id"), F.col("e.score").alias("score")))
