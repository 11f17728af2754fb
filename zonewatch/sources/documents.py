"""Elements of the arrays of large JSON documents, read in byte ranges by many tasks.

A document such as {"images": [{..}, ..], "annotations": [{..}, ..]} is one value, so a JSON reader gives the whole
of it to one task. Here the text source cuts it at every closing brace (a byte that is part of no other character
and that JSON has no escape for), which Spark splits into ranges like any file of lines. A range does not know what
it starts in, so

1. each range is looked at once for what it does to the parse state: whether its quotes are uneven, and, for a start
   outside and inside a string, how many braces deeper it ends and which key came last at each depth;
2. running totals over the ranges of a file (a few numbers each) give every range its true state at the start;
3. the ranges are read again and hand out the elements, the objects right below the outer one, with its key. An
   element that lies across ranges comes out in pieces, at most two of each range; these are put together.

Only an element has to fit in memory. In a document that ends early the last element may come out incomplete; it is
text that does not parse. Strings may hold braces and escaped quotes; a key of the outer object that itself holds a
closing brace is known by its end only where a range begins inside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonewatch.session import materialize, release

_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_SPACES = np.isin(np.arange(256), list(b" \t\r\n"))
_MARKS = np.isin(np.arange(256), list(b'"{}'))
RANGE = ["path", "start"]
#: States of ranges that may be broadcast; each is a path, two numbers and a key.
BROADCAST_RANGES = 50_000


class Marks:
    """Unescaped quotes and the braces of a stretch of whole pieces, each with its closing brace behind it.

    All of a stretch is worked out in array steps over its bytes: documents have many small pieces.
    """

    def __init__(self, text: bytes):
        self.text = text
        b = np.frombuffer(text, np.uint8)
        at = np.flatnonzero(_MARKS[b])
        kind = b[at]
        if b"\\" in text:  # a quote behind an odd number of backslashes is part of a string
            alive = np.flatnonzero(kind == 34)
            slashes, steps = np.zeros(len(at), np.int64), 1
            while len(alive):
                alive = alive[at[alive] >= steps]
                alive = alive[b[at[alive] - steps] == 92]
                slashes[alive] += 1
                steps += 1
            real = slashes % 2 == 0
            at, kind = at[real], kind[real]
        self.at, self.quote = at, kind == 34
        self.step = (kind == 123).astype(np.int8) - (kind == 125)
        self.quotes, self.quoted = np.cumsum(self.quote, dtype=np.int32), np.flatnonzero(self.quote)
        # quotes with a colon behind them close a key, if they close anything
        behind, end = at[self.quoted] + 1, len(b) - 1
        while True:
            space = (behind < end) & _SPACES[b[np.minimum(behind, end)]]
            if not space.any():
                break
            behind = behind + space
        self.named = self.quoted[(behind <= end) & (b[np.minimum(behind, end)] == 58)]


class Scan:
    """Parse state over stretches of text: in a string or not, open braces, the last key at each depth."""

    def __init__(self, inside: bool = False, depth: int = 0):
        self.inside, self.depth, self.keys, self.open = inside, depth, {}, [b""]

    def stretch(self, m: Marks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes in a stretch. Per brace outside strings its place, its step, and the depth behind it."""
        within = (m.quotes & 1) != self.inside  # behind each mark
        outer = ~(m.quote | within)
        depths = np.cumsum(m.step * outer, dtype=np.int32) + self.depth
        closing = m.named[~within[m.named]]
        self.found = closing, depths[closing]
        deep = self.found[1]
        for depth in range(int(deep.min()), int(deep.max()) + 1) if len(deep) else ():
            here = np.flatnonzero(deep == depth)
            if len(here):
                self.keys[depth] = self.key(m, int(closing[here[-1]]))
        if (int(m.quotes[-1]) if len(m.quotes) else 0) % 2 != self.inside:  # ends in a string
            self.open = [m.text[m.at[m.quoted[-1]] + 1:]] if len(m.quoted) else [*self.open, m.text]
        else:
            self.open = [b""]
        if len(m.quotes):
            self.inside, self.depth = bool(within[-1]), int(depths[-1])
        return m.at[outer], m.step[outer], depths[outer]

    def key(self, m: Marks, closing: int) -> str:
        """The string that a quote closes; its beginning may lie in stretches before."""
        n = m.quotes[closing]
        text = m.text[m.at[m.quoted[n - 2]] + 1:m.at[closing]] if n > 1 else b"".join(self.open) + m.text[:m.at[closing]]
        return _ESCAPED.sub(b"__", text).decode("utf-8", "replace")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes, tuple]]:
    """(path, start), text of some pieces, other columns: a range comes in one or several consecutive parts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rest = [c for c in batch.schema.names if c not in (*RANGE, "value")]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in RANGE:
            x = batch.column(c)
            new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new).tolist()
        for at, end in zip(starts, [*starts[1:], batch.num_rows]):
            row = {c: batch.column(c)[at].as_py() for c in (*RANGE, *rest)}
            # no copy per piece: the pieces and their braces are put together once
            text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, end - at], pa.int64()), batch.column("value").slice(at, end - at)
                                                                .cast(pa.large_binary())), pa.scalar(b"}", pa.large_binary()))[0].as_py() + b"}"
            yield (row["path"], row["start"]), text, tuple(row[c] for c in rest)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: uneven quotes; depth at its end and last keys by depth, for a start outside and inside a string."""
    key_map = pa.map_(pa.int64(), pa.string())

    def row(key, scans):
        out, within = scans
        return pa.record_batch([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([int(out.inside)], pa.int32()),
                                *(pa.array([s.depth], pa.int64()) for s in (out, within)),
                                *(pa.array([list(s.keys.items())], key_map) for s in (out, within))],
                               names=["path", "start", "odd", "deeper_out", "deeper_in", "keys_out", "keys_in"])
    now, scans = None, ()
    for key, text, _ in _stretches(batches):
        if key != now:
            if now is not None:
                yield row(now, scans)
            now, scans = key, (Scan(), Scan(True))
        marks = Marks(text)
        for s in scans:
            s.stretch(marks)
    if now is not None:
        yield row(now, scans)


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements that lie in one range (begins and ends), and what each range has of others."""
    now, scan, held, begins, out = None, Scan(), None, False, []

    def give(ends, key):
        out.append((*now, begins, ends, key, b"".join(held)))

    def batch():
        types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
        made = pa.record_batch([*(pa.array([r[i] for r in out], t) for i, t in enumerate(types)),
                                pa.array([r[5] for r in out], pa.binary()).cast(pa.string())],
                               names=["path", "start", "begins", "ends", "key", "element"])
        out.clear()
        return made
    for at, text, (inside, depth, last) in _stretches(batches):
        if at != now:
            if held:
                give(False, scan.keys.get(1))
            now, scan, begins = at, Scan(bool(inside), depth), False
            held = [] if depth >= 2 else None
            if last is not None:
                scan.keys[1] = last
        marks, key = Marks(text), scan.keys.get(1)
        head = scan.open
        places, steps, depths = scan.stretch(marks)
        closing, deep = scan.found
        tail, scan.open = scan.open, head  # keys that began before this stretch
        keys = [(int(marks.at[i]), scan.key(marks, int(i))) for i in closing[deep == 1]]
        scan.open = tail
        opens, ends = (steps == 1) & (depths == 2), (steps == -1) & (depths == 1)
        nth, begin = 0, 0 if held is not None else None
        for place, is_open in zip(places[opens | ends].tolist(), opens[opens | ends].tolist()):
            while nth < len(keys) and keys[nth][0] < place:
                key, nth = keys[nth][1], nth + 1
            if is_open:
                begin, held, begins = place, [], True
            elif held is not None:
                held.append(text[begin:place + 1])
                give(True, key)
                begin, held = None, None
        if held is not None:
            held.append(text[begin:])
        if out:
            yield batch()
    if held:
        give(False, scan.keys.get(1))
    if out:
        yield batch()


def read_elements(spark: SparkSession, path: str | list[str], glob: str = "*.json") -> DataFrame:
    """(path, key, element): every object below the outer object of each document, as text, with its outer key."""
    raw = spark.read.option("lineSep", "}").option("pathGlobFilter", glob).text(path)
    pieces = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                        F.monotonically_increasing_id().alias("n"), "value")
    sums = pieces.drop("n").mapInArrow(_effects, "path string, start bigint, odd int, deeper_out bigint, deeper_in bigint, "
                                       "keys_out map<bigint,string>, keys_in map<bigint,string>")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    from_zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    of = lambda name: F.when(F.col("inside") == 1, F.col(f"{name}_in")).otherwise(F.col(f"{name}_out"))
    placed = (sums.withColumn("inside", (from_zero("odd") % 2).cast("int")).withColumn("depth", from_zero(of("deeper")))
              .withColumn("own", F.element_at(of("keys"), 1 - F.col("depth")))
              .withColumn("last", F.last("own", ignorenulls=True).over(before)))
    states = materialize(placed.select(*RANGE, "inside", "depth", "last"))
    if states.count() <= BROADCAST_RANGES:
        told = pieces.drop("n").join(F.broadcast(states), RANGE)  # pieces stay in the order in which they are read
    else:
        told = pieces.join(states, RANGE).repartition(*RANGE).sortWithinPartitions(*RANGE, "n")
    found = materialize(told.select(*RANGE, "inside", "depth", "last", "value").mapInArrow(
        _elements, "path string, start bigint, begins boolean, ends boolean, key string, element string"))
    release(states)
    whole = found.filter("begins AND ends").select("path", "key", "element")
    nth = F.count_if("begins").over(Window.partitionBy("path").orderBy("start", "begins"))
    across = (found.filter("NOT (begins AND ends)").withColumn("nth", nth).groupBy("path", "nth")
              .agg(F.sort_array(F.collect_list(F.struct("start", "element"))).alias("p"), F.max(F.when(F.col("begins"), F.col("key"))).alias("key"),
                   F.bool_or("begins").alias("b"), F.bool_or("ends").alias("e")).filter("b AND e")
              .select("path", "key", F.array_join(F.transform("p", lambda x: x["element"]), "").alias("element")))
    return whole.unionByName(across)
